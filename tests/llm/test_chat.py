from veldra.llm import chat


def brute(rows, part_turns=4096):
    convs: dict = {}
    for c, n, role, text in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "unknown", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        for who in {r for _, _, r, _ in turns if r != "system"}:
            for lo in range(0, len(turns), part_turns):
                own = [(role, body) for _, _, role, body in turns[lo : lo + part_turns]]
                rules = [(role, body) for _, _, role, body in turns[:lo] if role == "system"]
                text, mask = "", []
                for role, body in rules[-1:] + own:
                    text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                    at = len(text)
                    text += body.replace("<|", "<\\|") + "<|end|>"
                    if role == who:
                        mask.append((at, len(text)))
                    text += "\n"
                out[c, who, lo // part_turns] = (len(own), text, mask)
    return out


def test_equals_brute_force(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "héllo <|end|> x"), (1, 2, "bob", "🙂 yes"), (1, 3, "cy", ""), (1, 4, "ann", "bye"), (1, 4, "ann", "bye"), (2, 0, "system", "alone"), (3, None, None, None), (3, 0, "ann", "z"), (None, 0, "ann", "q"), (4, 0, "a", "x"), (4, 300, "b", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, mask int")
    for part in (256, 3, 2, 1):
        got = {(r.conv_id, r.speaker, r.part): (r.n_turns, r.text, [(m.start, m.end) for m in r.mask]) for r in chat.perspectives(df, part_turns=part).collect()}
        assert got == brute(rows, part)
    assert chat.perspectives(df.limit(0)).count() == 0


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {(r.conv_id, r.speaker, r.part): r.n_turns for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: v[0] for k, v in brute(rows).items()}


def test_a_long_dialogue_is_rendered_whole(spark):
    rows = [(1, n, ("ann", "bob", "cy")[n % 3], f"turn {n} " + "x" * (n % 5)) for n in range(3000)] + [(2, 0, "ann", "y" * 500_000), (2, 1, "bob", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.part): (r.n_turns, r.text, [(m.start, m.end) for m in r.mask]) for r in chat.perspectives(df).collect()}
    assert got == brute(rows) and len(got) == 5


def test_turn_numbers_don_t_part_a_dialogue(spark):
    """Sparse, negative and huge turn numbers, time stamps and one number for all: a dialogue of few turns is whole."""
    numbers = [(4095, 4096), (-1, 0), (1_700_000_000, 1_700_004_000), (-(2**62), 2**62), (5, 5), (None, 3)]
    rows = [(c, n, who, f"says {n}") for c, pair in enumerate(numbers) for n, who in zip(pair, ("ann", "bob"), strict=True)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.part): (r.n_turns, r.text, [(m.start, m.end) for m in r.mask]) for r in chat.perspectives(df).collect()}
    assert got == brute(rows) and all(part == 0 and n == 2 for (_, _, part), (n, *_) in got.items())


def test_one_turn_number_without_end_goes_on_in_parts(spark):
    rows = [(1, 7, ("ann", "bob", "system")[k % 3], f"t{k}") for k in range(1000)] + [(2, k, "ann", "x") for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.part): (r.n_turns, r.text, [(m.start, m.end) for m in r.mask]) for r in chat.perspectives(df, part_turns=64).collect()}
    assert got == brute(rows, 64) and max(n for n, *_ in got.values()) == 64
