"""The queries that SQL can express, against DuckDB on whole tables."""

import glob
import os
import random

import duckdb
import pytest

from veldra.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_is_registered_once():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13


def test_quality_edge_cases(spark):
    from veldra.llm import quality

    common = "Read the terms of use before you go on."
    rows = [(i, common + "\n" + " ".join(f"w{i}x{k}" for k in range(60)), "h") for i in range(40)]
    rows += [(100 + i, common + "\n" + " ".join(f"v{i}y{k}" for k in range(2)), "h") for i in range(3)]
    rows += [(200, None, "h"), (201, "", None), (202, "a b c " * 40, "h"), (None, "x", "h"), (0, rows[0][1], "h"), (203, " ".join(f"z{k}" for k in range(70)), None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = quality.line_quality(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].kept and by[5].n_words == 69 and by[5].kept_words == 60 and by[203].kept
    assert by[200].n_words == 0 and by[200].base_failed and not by[201].kept
    assert by[202].n_repeat_words == 120 and by[202].base_failed
    assert quality.line_quality(df.limit(0)).count() == 0
    # depleted: long enough, but nearly all of it is what other documents say too
    lines = [" ".join(f"l{k}q{j}" for j in range(12)) for k in range(6)]
    many = [(i, "\n".join([*lines, f"own {i}"]), "h") for i in range(30)]
    assert not any(r.kept for r in quality.line_quality(spark.createDataFrame(many, "doc_id long, text string, source string")).collect())


def test_frequent_lines_leave_the_text(spark):
    from veldra.llm import quality

    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(15)]
    rows = [(i, f"Terms of  Use {i}\n\n{own[i]}\nterms of use 7\n", "en", "h", 9) for i in range(15)]
    rows += [(20, f"Terms of use 1\n{own[0]}", "en", "other", 9), (21, "\n" + own[1] + "\n", "en", None, None), (0, *rows[0][1:]), (22, None, "en", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [(i, f"\n{own[i]}\n", "en", "h", len(own[i]) + 2) for i in range(15)]
    want += [rows[15], rows[16], want[0]]
    assert sorted(map(repr, map(tuple, quality.stage(spark, docs, "").collect()))) == sorted(map(repr, want))


def test_long_lines_and_large_hosts_have_no_exemption(spark):
    from veldra.llm import quality

    licence = " ".join(f"l{chr(97 + k)}" for k in range(26)) + " since "
    rows = [(i, licence + f"{1990 + i}\n" + " ".join(f"w{i}x{k}" for k in range(80)), "h") for i in range(15)]
    rows += [(100 + i, licence + "1\n" + " ".join(f"v{i}x{k}" for k in range(5)) + "\n" + licence + "2", "h") for i in range(2)]
    got = {r.doc_id: r for r in quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].kept and got[3].kept_words == 80 and got[100].kept_words == 5 and not got[100].kept
    # 1,100 of 150,000 documents: under LINE_SHARE of the host, over LINE_MOST
    n = "concat_ws(' ', transform(sequence(0, 1), k -> concat('w', translate(cast(id * 2 + k as string), '0123456789', 'abcdefghij'))))"
    many = spark.range(150_000).selectExpr("id AS doc_id", f"if(id < 1100, concat('same line', chr(10), {n}), {n}) AS text", "'h' AS source")
    assert quality.line_quality(many).where("kept_words < n_words").count() == 1100


def test_the_verdict_equals_the_oracle_where_lines_decide(spark, tmp_path):
    """Documents that pass the base rules and are rejected for the lines that they share with others of their host."""
    rng = random.Random(2)
    shared = [" ".join(f"s{k}{chr(97 + j)}" for j in range(rng.randrange(3, 40))) for k in range(8)]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{i}x{rng.randrange(9999)}" for _ in range(rng.randrange(5, 40))) for _ in range(3)]
        lines = own + rng.sample(shared, rng.randrange(0, 8)) + [f"seen on {i}.{i % 7}.2020, page {i}"]
        rng.shuffle(lines)
        rows.append((i if i % 9 else None, "\n".join(x.upper() if rng.random() < 0.1 else x for x in lines), rng.choice(["a", "b", None])))
    rows += rows[:3] + [(500, None, "a"), (501, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op8_line_quality"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLES["op8_line_quality"])
    names = [d[0] for d in want.description]
    rows = list(map(tuple, got.select(names).collect()))
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    failed, kept = names.index("base_failed"), names.index("kept")
    assert sum(not r[failed] and not r[kept] for r in rows) > 10 and sum(r[kept] for r in rows) > 10


def test_quality_stage_with_clashing_names_and_without_sources(spark):
    from veldra.llm import quality

    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("d1", text, 7, "x"), ("d2", "short", 8, "y"), (None, text, 9, None)], "doc_id string, text string, _place long, _gone string")
    assert sorted(map(repr, map(tuple, quality.stage(spark, docs, "").collect()))) == sorted(map(repr, [("d1", text, 7, "x"), (None, text, 9, None)]))
