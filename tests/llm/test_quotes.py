from basepaths.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, parent string"
A = "Shall we meet on Monday?\nI could bring the maps."
ROWS = [
    (1, 0, "user", A),
    (1, 1, "assistant", "> Shall we meet on MONDAY\n\nYes, gladly so."),
    (1, 2, "user", "On Tuesday Ann wrote:\n> > Shall we meet on Monday?\n> > I could bring the maps.\n> Yes, gladly so.\nThen at nine."),
    (1, 3, "user", "> > > I could bring the maps.\n> Then at\n> nine.\nSee you there then."),
    (2, 0, "user", "> I could bring the maps.\nWhich maps do you mean?"),
    (2, 1, "user", ">quoted but never said anywhere\nHm."),
    (2, 2, "user", None),
    (2, 3, "user", ""),
    (2, 4, None, ">\n>\n"),
    (None, 5, "user", "> Shall we meet on Monday?\nno id"),
    (3, 0, "user", "> later words are no source\nearly"),
    (3, 1, "user", "later words are no source"),
    (4, 0, "user", A),
]


def test_links_and_threads(spark):
    got = {(r.conv_id, r.turn): r for r in Q.conversations(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)).collect()}
    assert len(got) == len(ROWS)
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items() if r.parent_turn is not None}
    assert parent == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 2), (2, 0): (1, 0)}
    assert [got[k].depth for k in [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]] == [0, 1, 2, 3, 1, 0]
    assert all((got[k].thread_conv, got[k].thread_turn) == (1, 0) for k in parent)
    assert got[1, 2].text == "Then at nine." and got[1, 1].text == "Yes, gladly so." and got[2, 2].text is None and got[2, 4].text == ""
    assert [got[k].n_quotes for k in [(1, 2), (1, 3), (2, 1), (2, 4)]] == [2, 2, 1, 0] and got[1, 2].n_linked == 2
    thread = sorted((r for r in got.values() if (r.thread_conv, r.thread_turn) == (1, 0)), key=lambda r: r.reply_path)
    assert [(r.conv_id, r.turn) for r in thread] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]


def test_long_chain_and_empty_table(spark):
    rows = [(1, 0, "user", "message number zero says this", None)]
    names = "one two three four five six seven eight nine ten".split()
    for i, name in enumerate(names):
        before = "zero" if not i else names[i - 1]
        rows.append((1, i + 1, "user", f"> message number {before} says this\nmessage number {name} says this", None))
    docs = spark.createDataFrame(rows * 2, SCHEMA)
    got = Q.conversations(docs).collect()
    assert sorted(r.depth for r in got) == sorted(list(range(11)) * 2) and {r.thread_turn for r in got} == {0}
    assert Q.conversations(docs.limit(0)).collect() == []
