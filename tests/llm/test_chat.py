from siftline.llm import chat as C


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for _, r, t in turns)


def brute(rows):
    """A row without an id is a conversation of its own."""
    conversations = {}
    for i, (conv, turn, role, text) in enumerate(rows):
        conversations.setdefault((conv, i if conv is None else 0), []).append((turn, role or "", text or ""))
    ordered = {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, t in conversations.items()}
    plain = {c: tuple((r, t) for _, r, t in turns) for c, turns in ordered.items()}
    out = set()
    for c, turns in plain.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in plain.values()):
            continue
        same = [k for k, o in plain.items() if o == turns]
        out.add((min((k for k, _ in same if k is not None), default=None), len(turns), len(same), render(ordered[c])))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, 5, "user", "hi"), (5, 9, "assistant", "hello"), (5, 10, "user", "more"), (6, 0, "user", "more"), (6, 1, "assistant", "hello"), (6, 2, "user", "hi"),
    (7, None, "user", None), (7, 1, None, "x"), (8, 0, "user", ""), (9, 0, "user", "a"), (9, 0, "user", "a"), (10, 0, "user", "a"), (11, 1, "b", "2"), (11, 1, "a", "1"), (None, 0, "user", "alone"),
    (12, 0, "user", "z" * 50_000), (13, 0, "user", "userhi"), (14, 0, "us", "erhi"), (None, 1, "user", "rest"), (15, 0, None, None),
    (None, 7, "user", "twice"), (None, 8, "user", "twice"), (None, None, "user", "a"), (None, 0, "us", "erhi"),
]


def test_equals_brute_force(spark):
    table = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "conv_id long, turn long, role string, text string, h1 string, n_copies string").repartition(3)
    got = C.format_chats(table).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_many_snapshots_of_one_conversation(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(12)]
    rows = [(c, i, *turns[i]) for c in range(120) for i in range(1 + c % 12)]
    got = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(11, 12, 10)]


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_plan_has_no_python(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = C.format_chats(table)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_null_ids_are_no_group(spark):
    rows = [(None, 0, "user", f"t{i % 7}") for i in range(5000)]
    got = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.conv_id, r.n_turns, r.chat) for r in got.collect())[0][1] == 1 and sum(r.n_copies for r in got.collect()) == 5000 and got.count() == 7


def test_renders_after_the_anti_join(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = C.format_chats(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("LeftAnti")  # the anti-join stands under the aggregate that gathers turns
