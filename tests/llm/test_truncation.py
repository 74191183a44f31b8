import pytest

from noteglass.llm import truncation

HEAD = "### Changed this session\n\nMoved the counter to another file.\n\n### Ruled out\n\nNone.\n\n### Still undecided\n\nNone.\n\n### Watch out\n\n"
SCHEMA = "src string, rec_id bigint, pos int, origin string, stop string, message string, last boolean, text string"
NOTES = {
    1: (HEAD + "Everything is in order here.", "end_turn", False), 2: (HEAD + "Everything is in ord", "end_turn", True), 3: (HEAD + "Everything is in order here.", "MAX_TOKENS", True), 4: (HEAD[: HEAD.index("### Still")], "end_turn", True), 5: (HEAD + "Moved the cou…", "end_turn", True),
    6: (HEAD + "A log said so. [truncated]", "end_turn", False), 7: (HEAD + "It stopped at [truncated]", None, True), 8: (HEAD + "```\ncode(1)\n```", "end_turn", False), 9: (HEAD + "```\ncode(1)", "end_turn", True), 10: ("", "end_turn", False), 11: (None, "max_tokens", False), 12: ("-", "length", False),
    13: (HEAD + "| a | b |", "end_turn", False), 14: (HEAD.replace("\n\nNone.\n", "\n").replace("Moved the counter to another file.\n\n", ""), "end_turn", False), 15: ("I can't help with that.", "refusal", False), 16: ("ÉCARTÉ\n\nrien.\n\nÀ TRANCHER\n\nrien.", "end_turn", True), 17: ("Moved the counter to ano�", "end_turn", True), 18: (HEAD + "x" * 10_000 + " end.", "end_turn", False),
}


def test_notes(spark):
    rows = [("distillations", k, 0, "store", s, None, True, t) for k, (t, s, _) in NOTES.items()]
    got = {r.rec_id: r.cut for r in truncation.evidence(spark.createDataFrame(rows + rows[:1], SCHEMA)).collect()}
    assert got == {k: c for k, (_, _, c) in NOTES.items()}


def test_turns(spark):
    turn = lambda i, pos, text, stop, message=None, last=True: ("attack_failures", i, pos, "store", stop, message, last, text)
    rows = [turn(1, 1, "All of it.", "end_turn", last=False), turn(1, 2, None, "max_tokens"), turn(2, 1, '{"claims": ["bee"', "end_turn"), turn(3, 1, '{"claims": ["bee"]}', "end_turn"), turn(4, 1, None, "refusal"), turn(5, 1, None, None, "turn 1 stopped at max_tokens"), turn(6, 1, None, None, "socket closed"), turn(7, 1, "All of it.", "length")]
    got = {(r.rec_id, r.pos) for r in truncation.evidence(spark.createDataFrame(rows, SCHEMA)).where("cut").collect()}
    assert got == {(1, 2), (2, 1), (5, 1), (7, 1)}


def test_length_limit_of_an_origin(spark):
    body = lambda n: (HEAD + "words and " * 60)[: n - 1] + "."
    rows = [("distillations", k, 0, "bridge", "end_turn", None, True, body(500)) for k in range(4)] + [("distillations", 9, 0, "bridge", "end_turn", None, True, body(400)), ("distillations", 10, 0, "other", "end_turn", None, True, body(500)), ("distillations", 11, 0, None, "end_turn", None, True, body(500))]
    got = {r.rec_id for r in truncation.evidence(spark.createDataFrame(rows, SCHEMA)).where("limit").collect()}
    assert got == {0, 1, 2, 3}


def test_trie_marks_unknown_prefixes(spark):
    texts = spark.createDataFrame([("counter counter stop",), ("counter again stop",), ("again x",)], "text string")
    nodes = {r.node: (r.below, r.is_word) for r in truncation.trie(truncation.words(texts)).collect()}
    assert nodes["counter"] == (0, True) and nodes["coun"] == (1, False) and "stop" not in nodes and nodes["a"] == (1, False)


def test_words_longer_than_the_trie_is_deep(spark):
    long = "x" * 45 + "yz"
    words = spark.createDataFrame([(long, 3, 0), ("y" * 44, 2, 2), ("short", 2, 0)], "word string, n bigint, ended bigint")
    tokens = spark.createDataFrame([(long[:-1],), (long,), ("x" * 41 + "q",), ("x" * 40,), ("y" * 44,), ("sho",), ("none",)], "token string")
    got = {r.token: (r.prefix, r.is_word, r.rare) for r in truncation.look_up(tokens, words).collect()}
    assert got == {long[:-1]: (True, False, False), long: (False, True, True), "x" * 40: (True, False, False), "y" * 44: (False, True, False), "sho": (True, False, False)}


def test_the_trie_decides_texts_that_end_in_a_letter(spark):
    """Only the trie tells a cut word, and a word in mid-sentence, from a last line without a full stop."""
    done = [("distillations", k, 0, None, "end_turn", None, True, f"{HEAD}The relay of the depot is open\nIt depends on the depot.") for k in range(60)]
    asked = {101: "It depends on the dep", 102: "It depends on the", 103: "The relay is open", 104: "It depends on zzz"}
    rows = [*done, *(("distillations", k, 0, None, "end_turn", None, True, HEAD + t) for k, t in asked.items())]
    frame = spark.createDataFrame(rows, SCHEMA)
    cut = {r.rec_id for r in truncation.evidence(frame).where("cut").collect()}
    assert cut == {101, 102}
    none = spark.createDataFrame([], "word string, n bigint, ended bigint")
    assert truncation.evidence(frame, none).where("cut").count() == 0


def test_cuts_of_the_tables_that_need_the_trie(spark, data):
    """Without the trie, p3_found loses cuts: at sf0.1 23 of 512, at sf0.01 3 of 56, here 1 of 9."""
    rows = truncation.values(spark, data)
    whole = truncation.evidence(rows).where("cut").select("src", "rec_id", "pos").distinct()
    none = truncation.evidence(rows, spark.createDataFrame([], "word string, n bigint, ended bigint")).where("cut").select("src", "rec_id", "pos").distinct()
    assert none.exceptAll(whole).count() == 0 and (whole.count(), whole.exceptAll(none).count()) == (9, 1)


def test_tables(spark, data):
    got = truncation.cut_texts(spark, data)
    assert got.columns == ["src", "rec_id", "pos"] and got.count() == got.distinct().count() > 0
    share = truncation.shares(spark, data).collect()
    assert all(0 <= r.n_cut <= r.n_records and r.share is not None for r in share)


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, empty):
    assert truncation.evidence(spark.createDataFrame([], SCHEMA)).collect() == []
