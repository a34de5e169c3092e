import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.sources import sample_source
from veldra.sources.catalogue import Benchmark, Dataset, catalogue, check, ground_truth_errors, read_samplers
from veldra.sources.samplers import Sampler, integer_uniform, log_uniform, sample, uniform
from veldra.sources.tables import TableStore


def test_samplers(spark):
    kinds = [uniform(1, 5), log_uniform(0.1, 10, True, False), integer_uniform(1, 10, False, True), uniform(-3, 4, True, False)]
    df = sample(spark, kinds, 20_000, 3)
    r = df.agg(F.min(F.abs("x0")), F.max("x0"), F.min("x0"), F.min("x1"), F.max("x1"), F.min("x2"), F.max("x2"), F.count_distinct("x2"), F.min("x3"), F.max("x3"), F.avg((F.col("x0") > 0).cast("int"))).first()
    assert 1 <= r[0] and 4.9 < r[1] <= 5 and -5 <= r[2] < -4.9 and 0.1 <= r[3] and r[4] <= 10 and r[5] == -9 and r[6] == -1 and r[7] == 9 and -3 <= r[8] and r[9] <= 4 and 0.45 < r[10] < 0.55
    rng = np.random.default_rng(1)
    for s in kinds:
        v = s.draw(1000, rng)
        assert Sampler.from_dict(s.to_dict()) == s and np.abs(v).max() <= 10
    with pytest.raises(ValueError):
        uniform(0, 1, False, False)
    with pytest.raises(ValueError):
        Sampler("other", 0, 1)


def test_python_data_source(spark):
    s = [uniform(0, 1, True, False), integer_uniform(1, 4, True, False)]
    a = sample_source.read(spark, s, 1000, 5, 4)
    assert a.count() == 1000 and a.select("row_id").distinct().count() == 1000
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sample_source.read(spark, s, 1000, 5, 4).collect()))
    assert sample_source.read(spark, s, 0, 5).count() == 0


def test_catalogue(spark):
    c = catalogue()
    assert {k: len(b) for k, b in c.items()} == {"Nguyen": 10, "Feynman": 100, "SRSD": 120} and not any(check(b) for b in c.values())
    assert len(c["Feynman"].list(2)) == 15 and c["Nguyen"].list(2) == ["NG-10", "NG-9"]
    assert len(read_samplers("2*L+[1.0,10.0] U+-[-1,2] I-[1,5]")) == 4
    few = Benchmark("few", datasets=[Dataset.from_dict(d.to_dict()) for d in list(c["Feynman"])[:6]])
    rows = ground_truth_errors(spark, few, 200).collect()
    assert all(r.error <= 1e-7 and r.finite > 0 for r in rows)


def test_datasets_store_and_archives(spark, tmp_path):
    d = Dataset("plane", "X_0 + X_1".split(), [uniform(0, 1), uniform(0, 1)], rows=40, seed=2)
    b = Benchmark("own", "1.2.0", [d])
    with pytest.raises(ValueError):
        b.add(Dataset("plane"))
    with pytest.raises(ValueError):
        b.add(Dataset("bed", ranking="bed"))
    store = TableStore(str(tmp_path / "store"))
    first = b.create(spark, "plane", store).orderBy("row_id").collect()
    assert b.create(spark, "plane", store).orderBy("row_id").collect() == first and len(first) == 40
    assert b.create(spark, "plane", store, 7).count() == 7
    d.rows = 50
    with pytest.warns(UserWarning, match="another description"):
        assert b.create(spark, "plane", store).count() == 40
    assert d.load(spark, store, force=True).count() == 50
    b2 = Benchmark("own", "1.10.0", [Dataset("plane", d.tokens, d.samplers, rows=5)])
    b2.create(spark, "plane", store)
    assert [m["version"] for m in store.list(spark)] == ["1.2.0", "1.10.0"]
    assert store.collect(spark, 1) == [("own", "1.2.0")] and len(store.list(spark)) == 1
    with pytest.raises(FileNotFoundError):
        store.resolve(spark, "none", "1", "x", None)
    b.save(spark, str(tmp_path / "archive"))
    again = Benchmark.open(spark, str(tmp_path / "archive"))
    assert again.create(spark, "plane").count() == 50 and again.datasets["plane"].tokens == d.tokens
    assert b.frame(spark).count() == 1 and "plane" in str(d)
    with pytest.raises(ValueError):
        Dataset("x", ["X_0"]).sample(spark)


def test_archives_of_arrays(spark, tmp_path):
    import zipfile

    from veldra.sources.archives import import_archive, in_memory, members, read_npz

    x, y = np.arange(6.0).reshape(3, 2), np.array([1.0, 2, 3])
    np.savez(tmp_path / "d1.npz", X=x, y=y)
    np.savez(tmp_path / "d2.npz", X=x)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "d1.npz", "data/d1.npz")
        z.write(tmp_path / "d2.npz", "data/d2.npz")
    store = TableStore(str(tmp_path / "store"))
    assert import_archive(spark, store, (tmp_path / "a.zip").as_uri(), "b", "1") == ["d1", "d2"]
    assert store.resolve(spark, "b", "1", "d1", None).columns == ["row_id", "x0", "x1", "y"]
    assert read_npz(spark, str(tmp_path / "d2.npz")).count() == 3
    d, df = in_memory(spark, "mine", x, y, str(tmp_path / "mine"))
    assert d.load(spark).count() == df.count() == 3 and d.num_variables == 2
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../d.npz", b"")
    with pytest.raises(ValueError):
        members(str(tmp_path / "bad.zip"))


def test_mirrored_values_are_drawn_once(spark):
    df = sample(spark, [uniform(1, 5), log_uniform(0.1, 10)], 20_000, 3)
    for c in ("x0", "x1"):
        got = [r[0] for r in df.select(c).collect()]
        assert len({abs(x) for x in got}) > 19_990 and 9_500 < sum(x > 0 for x in got) < 10_500


def test_variants_bring_back_every_number(spark, tmp_path):
    import struct

    from pyspark.sql.types import StructField, StringType

    from veldra.sources.variants import packed, unpacked

    numbers = [0.1, -0.0, 0.0, 1e308, 5e-324, 123456789.123456789, float("nan"), float("inf"), -float("inf"), None, 2.0**53 + 1, 1e22, -1.5e-7]
    rows = [(k, x, [x, 1.5], f'say "{k}" \\ é', k * 10**12, None if k == 3 else [[x], []]) for k, x in enumerate(numbers)]
    df = spark.createDataFrame(rows, "id int, `an error` double, some array<double>, name string, n long, deep array<array<double>>")
    packed(df, "id").write.parquet(f"{tmp_path}/v")
    fields = [f for f in df.schema.fields if f.name != "id"]
    got = sorted(map(tuple, unpacked(spark.read.parquet(f"{tmp_path}/v"), fields).collect()))
    bits = lambda x: None if x is None else struct.pack(">d", x) if x == x else "nan"
    for want, row in zip(rows, got, strict=True):
        assert bits(row[1]) == bits(want[1]) and [bits(x) for x in row[2]] == [bits(x) for x in want[2]]
        assert row[3:5] == want[3:5] and (row[5] is None if want[5] is None else bits(row[5][0][0]) == bits(want[5][0][0]) and row[5][1] == [])
    lacking = unpacked(packed(df, "id"), [StructField("absent", StringType())]).first()
    assert lacking["absent"] is None
