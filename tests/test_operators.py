"""Goldens and edge cases of the core operators."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cardloom.functions.text import csv_field, index_of, last_line, safe_name, split_lines, split_sentences, token_estimate, unicode_trim, without_last_line
from cardloom.operators.cards import completion_status, conversation, message, parse_cards, parse_response, prompts, template_of, wrapped
from cardloom.operators.chunker import chunk, chunk_block, chunk_text
from cardloom.operators.density import card_counts, intensity, thresholds
from cardloom.operators.guard import AllowedTexts, active_rules, banned_spans, banned_tokens, immediate_repeats, line_repeat_stop, low_diversity_stop, progress_fold, rewound, sequence_bans, single_token_bans, tokens_of
from cardloom.operators.html import plain_text
from cardloom.operators.queue import admit, fifo_batches, gate
from cardloom.operators.rules import Generation, Rule, RuleSet, permitted, replay
from cardloom.operators.steps import run_steps
from cardloom.operators.references import chunk_states, orphan_references, orphans
from cardloom.operators.sampling import draw, greedy, min_p, sample, softmax, top_k, top_p
from cardloom.operators.skew import skew_left_join
from cardloom.operators.store import delete_chunks, details, details_of, fold_log, number_rows, restore_chunks, resubmitted, retry_chunks, update_cards


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("x")).head().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Hello world.\n", [("Hello world.", 0, 12)]),
        ("x" * 750 + "\n" + "y" * 100, [("x" * 750, 0, 750), ("y" * 100, 750, 850)]),
        ("A.\n\nB.\n", [("A.B.", 0, 4)]),
        ("a" * 650 + "\n\n" + "b" * 60, [("a" * 650, 0, 650), ("b" * 60, 650, 710)]),
        ("", []), (None, []), (" \n\t\n", []),
        ("s" * 2803, [("s" * 2803, 0, 2803)]), ("s" * 2804, [("s" * 2804, 0, 2804)]),
    ],
)
def test_chunk_goldens(text, expected):
    assert chunk_text(text) == expected


def test_chunk_block_stale_start():
    assert chunk_block("One two three. Four five.\n\nend", 0, 3, 2) == [("One two three.", 0, 14), ("Four five.", 14, 24), ("end", 0, 27)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n!é🧬", max_size=400))
def test_chunks_lose_nothing(text):
    chunks = chunk_text(text, max_tokens=5, min_tokens=3, flush_chars=30)
    assert "".join("".join(c for c, _, _ in chunks).split()) == "".join(text.split())
    assert all(a[2] <= b[2] for a, b in zip(chunks, chunks[1:]))


def test_chunk_frame(spark):
    df = spark.createDataFrame([(1, "A.\n\nB.", "x"), (2, None, "y"), (3, "", "z")], "doc long, text string, content string")
    assert [tuple(r) for r in chunk(df, "text", ["doc"]).collect()] == [(1, 0, "A.B.", 0, 4)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<think>Q: no\nA: no</think>\nQ: What is X?\nA: Y.", [("What is X?", "Y.")]),
        ("Q: a\nQ: b\nA: c", [("b", "c")]),
        ("Q: one\nmore\nA: x\nA: y\nQ: two\nA: z", [("one\nmore", "x\nA: y"), ("two", "z")]),
        ("Q:Queue?\nA:Answer", [("ueue?", "nswer")]),
        ("  Q: x\n  A: y", [("Q: x", "A: y")]),
        ("intro only", []), ("", []), (None, []),
        ("Q: a\r\nA: b\r\n", [("a", "b")]),
        ("Q: a\nA:", [("a", "")]),
    ],
)
def test_parse_goldens(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id long, response string")
    assert [(r.question, r.answer) for r in parse_cards(df, "response", ["id"]).orderBy("card_no").collect()] == expected


def test_parse_strict(spark):
    df = spark.createDataFrame([(1, "Q:Queue?\nA:Answer")], "id long, response string")
    assert [(r.question, r.answer) for r in parse_cards(df, "response", ["id"], strict=True).collect()] == [("Queue?", "Answer")]


@pytest.mark.parametrize(
    "counts, limits, levels",
    [
        ([1, 2, 3, 4, 5, 0], [1, 2, 3, 4], {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 0: 0}),
        ([7], [7, 7, 7, 7], {7: 1}),
        ([1, 1, 2, 10, 10, 10], [1, 1, 2, 10], {1: 1, 2: 3, 10: 4}),
        ([0, 0], None, {0: 0}),
    ],
)
def test_density_goldens(spark, counts, limits, levels):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "chunk_id long, flash_card_count long")
    assert thresholds(df).head().limits == limits
    assert {r.flash_card_count: r.intensity for r in intensity(df).collect()} == levels


def test_card_counts(spark):
    chunks = spark.createDataFrame([(1, "f"), (2, "f"), (2, "f")], "id long, file_id string")
    cards = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, None), (4, 9)], "id long, origin_id long")
    assert sorted(tuple(r) for r in card_counts(chunks, cards).collect()) == [("f", 1, 2), ("f", 2, 0)]


def test_text_functions(spark):
    assert one(spark, "a😀b", token_estimate(F.col("t"))) == 1 and one(spark, None, token_estimate(F.col("t"))) == 0
    assert one(spark, "  x ", unicode_trim(F.col("t"))) == "x"
    assert one(spark, "﻿a\r\nb\rc\n\n", split_lines(F.col("t"))) == ["a", "b", "c", ""] and one(spark, "", split_lines(F.col("t"))) == []
    assert one(spark, "A b. C!  D?", split_sentences(F.col("t"))) == ["A b.", "C!", "D?"]
    assert one(spark, "a\n b ", last_line(F.col("t"))) == "b" and one(spark, "a \n b ", without_last_line(F.col("t"))) == "a"
    assert one(spark, "abcabc", index_of(F.col("t"), "c", 3)) == 5 and one(spark, "abc", index_of(F.col("t"), "", 3)) == -1
    assert one(spark, 'a"q\nz', csv_field(F.col("t"))) == '"a""q\nz"'
    assert one(spark, "a/b c-1_2.x!", safe_name(F.col("t"))) == "abc-1_2.x"


def test_html():
    page = "<title>T</title><!-- c --><p>One &amp; <b>two</b><br/>x</p><ul><li>a</li><li>b</li></ul><script>var s='</p>'</script><style>p{}</style>"
    assert plain_text(page) == "T\r\nOne & two\r\nxab"
    assert plain_text(None) is None and plain_text("") == ""


def test_prompts(spark):
    df = spark.createDataFrame([(1, "c", "ctx"), (2, "c", ""), (3, None, None)], "id long, content string, extra_context string")
    got = {r.id: r.prompt for r in prompts(df, "S", prefix="<", suffix=">").collect()}
    assert got == {1: "<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST]<ctx>c[/INST]", 2: "<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST]c[/INST]", 3: "<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST][/INST]"}
    assert prompts(df.where("id = 2"), "S", compat=True).head().prompt == "<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT]c[/INST]"
    with pytest.raises(ValueError):
        message("tool", F.lit("x"))


def test_conversation(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "System", "a"), (1, 1, "user", "b")]
    df = spark.createDataFrame(rows, "k long, turn int, role string, text string")
    assert conversation(df, "k", "turn", "role", "text").head().prompt == "<s>[SYSTEM_PROMPT]a[/SYSTEM_PROMPT][INST]b[/INST]c</s>"
    with pytest.raises(Exception, match="unknown role"):
        conversation(spark.createDataFrame([(1, 0, "tool", "x")], df.schema), "k", "turn", "role", "text").collect()


def test_completion_status(spark):
    df = spark.createDataFrame([(0, None, False), (2, None, False), (2, "boom", False), (0, None, True)], "n long, e string, c boolean")
    assert [r.s for r in df.select(completion_status(F.col("n"), F.col("e"), F.col("c")).alias("s")).collect()] == ["Failed: No flashcards parsed from LLM response.", "Completed: 2 cards created", "Failed: boom", "Cancelled"]


def tokens(spark, words, key=1):
    return spark.createDataFrame([(key, i, w) for i, w in enumerate(words)], "k long, idx int, token string")


@pytest.mark.parametrize("phrase, expected", [("llo worl", [(0, 3, 4)]), (" worl", [(2, 3, 2)]), ("XYZ", []), ("lo", [(1, 1, 1)])])
def test_banned_spans(spark, phrase, expected):
    got = banned_spans(tokens(spark, ["Hel", "lo", " wor", "ld"]), "k", [phrase], separator="").collect()
    assert [(r.first_idx, r.last_idx, r.rewind) for r in got] == expected


def test_token_rules(spark):
    rules = spark.createDataFrame([("a", 5, 3), ("b", 0, 0)], "token string, start int, duration int")
    steps = spark.createDataFrame([(s, t) for s in range(4, 10) for t in "ab"], "step int, token string")
    assert sorted((r.step, r.token) for r in banned_tokens(steps, rules).collect()) == sorted([(5, "a"), (6, "a"), (7, "a")] + [(s, "b") for s in range(4, 10)])
    at = rules.crossJoin(spark.createDataFrame([(8,)], "step int"))
    assert [r.token for r in active_rules(at, "step").collect()] == ["b"]
    assert [r.idx for r in sequence_bans(tokens(spark, ["x", "a", "b", "a", "b"]), "k", [["a", "b"]]).collect()] == [2, 4]
    assert [(r.token, r.phrase) for r in single_token_bans(tokens(spark, ["car", "bus"]).select("token"), ["ar"]).collect()] == [("car", "ar")]


def test_allowed_texts():
    t = AllowedTexts(["Hello"])
    assert t.allows("", "He") and t.allows("", "H") and not t.allows("", "llo") and not t.allows("", "World") and t.allows("He", "llo")
    t = AllowedTexts(["A", "B"])
    assert t.allows("A", "B") and not t.allows("A", "C")
    t = AllowedTexts(["Hello", "World"])
    assert t.allows("He", "lloWorld")
    t = AllowedTexts(["AB", "AC"])
    assert t.allows("A", "B") and t.allows("A", "C")
    assert not AllowedTexts(["A", "AB"]).allows("A", "B")


def test_progress(spark):
    events = [("ab", 0), ("cd", 0), ("", 3), ("Z", 0)]
    assert rewound(events) == "aZ"
    df = spark.createDataFrame([(1, i, t, r) for i, (t, r) in enumerate(events)] + [(1, 0, "ab", 0), (2, 0, None, 5)], "k long, seq long, token string, rewind int")
    assert {r.k: r.text for r in progress_fold(df, "k", "seq", "token", "rewind").collect()} == {1: "aZ", 2: ""}


def test_repetition_stops(spark):
    words = [str(i % 4) for i in range(21)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20])), (3, None), (4, "")], "k long, t string")
    assert [tuple(r) for r in low_diversity_stop(df, "k", "t").collect()] == [(1, 20)]
    lines = [(1, "foo bar\nx\nFoo Bar"), (2, "<think>\nab c\nab c\nab c\nAB C"), (3, "A: same\nA: same\nxy\nxy"), (4, "<think>\nabc\nabc\n</think>\nabc\nabc"), (5, None)]
    got = line_repeat_stop(spark.createDataFrame(lines, "k long, t string"), "k", "t").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (2, 4), (4, 5)]
    assert [(r.idx, r.banned_until) for r in immediate_repeats(tokens(spark, ["a", "a", "b"]), "k").collect()] == [(1, 4)]
    assert tokens_of(df.where("k > 2"), "k", "t").count() == 0


def test_sampling(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([2.0, 1.5, 0.5, -1.0])], "g long, token_id int, logit double")
    assert [round(r.p, 4) for r in softmax(df, ["g"]).orderBy("token_id").collect()] == [0.5321, 0.3227, 0.1187, 0.0265]
    assert top_p(df, ["g"]).count() == 3 and min_p(df, ["g"]).count() == 3 and top_k(df, ["g"], 2).count() == 2
    assert greedy(df, ["g"]).head().token_id == 0 and sample(df, ["g"], temperature=0).head().token_id == 0
    assert sample(df, ["g"], banned=F.col("token_id") == 0, temperature=0).head().token_id == 1
    many = spark.range(4000).select(F.col("id").alias("g")).crossJoin(df.drop("g"))
    shares = {r.token_id: r.n / 4000 for r in draw(many, ["g"], 1.0).groupBy("token_id").agg(F.count("*").alias("n")).collect()}
    assert abs(shares[0] - 0.532) < 0.04 and abs(shares[1] - 0.323) < 0.04


def test_queue(spark):
    df = spark.createDataFrame([(i, "q", 100 * (i == 3) + 10) for i in range(1, 8)], "id long, q string, n long")
    assert [r.batch_no for r in fifo_batches(df, ["id"], 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2]
    got = admit(df, "id", "q", ["id"], F.col("n"), 60, 3, slack=10).orderBy("id").collect()
    assert [r.id for r in got if r.admitted] == [1, 2, 4] and [r.id for r in got if not r.fits_alone] == [3]


def test_gate(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, at + dt.timedelta(seconds=s), 0) for i, s in enumerate([0, 1, 2, 50])] + [(9, None, 0)], "id long, at timestamp, group_first int")
    got = {r.id: (r.released_at - at).total_seconds() for r in gate(df, "at", "id", 3, 90).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 140} and gate(df.limit(0), "at", "id", 3, 90).count() == 0


def test_gate_over_many_blocks(spark):
    rng, now, rows = random.Random(8), 0, []
    for i in range(1500):
        now += rng.choice([0, 1, 3, 10, 40, 200, 5])
        rows.append((i, now))
    want, group, i = {}, 0, 0
    while i < len(rows):
        j = i
        while j < len(rows) and j - i < 8 and rows[j][1] <= rows[i][1] + 90:
            j += 1
        want |= {k: (group, rows[j - 1][1] if j - i == 8 else rows[i][1] + 90) for k in range(i, j)}
        group, i = group + 1, j
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(rows, "id long, t long").withColumn("at", F.timestamp_seconds("t"))
        got = {r.id: (r.group_no, r.s) for r in gate(df, "at", "id", 8, 90).withColumn("s", F.unix_timestamp("released_at")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_numbers_over_many_partitions(spark):
    """A wide payload and small partitions: every number once, in order, and no row lost."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        df = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 80).alias("wide"))
        got = number_rows(df, ["k"], "n", 5)
        told = got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.countDistinct("k")).head()
        ordered = got.select("n", "k", F.lag("k").over(Window.partitionBy(F.floor(F.col("n") / 1000)).orderBy("n")).alias("before")).where("before >= k").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert tuple(told) == (1_000_000, 1_000_000, 5, 1_000_004, 1_000_000) and ordered == 0


def test_retry_and_resubmit(spark):
    chunks = spark.createDataFrame([(1, "f", "a", ""), (2, "f", "b", "c"), (5, "g", None, None)], "id long, file_id string, content string, extra_context string")
    cards = spark.createDataFrame([(1, "q", "a", 2), (2, "q", "a", 1), (3, "q", "a", None)], "id long, question string, answer string, origin_id long")
    ids = spark.createDataFrame([(2,), (2,), (77,)], "id long")
    kept, left, anew = retry_chunks(chunks, cards, ids, 5)
    assert {r.id for r in kept.collect()} == {1, 5} and {r.id for r in left.collect()} == {2, 3} and [(r.old_id, r.id) for r in anew.collect()] == [(2, 6)]
    assert sorted((r.old_id, r.extra_context) for r in resubmitted(chunks, ids.union(spark.range(1, 2))).collect()) == [(1, None), (2, "c")]


# --- rules ---


def generation(rules, *tokens, control=frozenset()):
    now = Generation(rules, control)
    met = [now.accept(t) for t in tokens]
    return now, met


@pytest.mark.parametrize("rule, expected", [(Rule("ban", "text", "llo worl"), (4, "Hel", 0, 3)), (Rule("ban", "text", " worl"), (2, " wor", 2, 3)), (Rule("ban", "text", "llo worl", ban_last=True), (1, "ld", 3, 3)), (Rule("ban", "text", "XYZ"), None), (Rule("ban", "tokens", ("lo", " wor", "ld"), 0, 7), (3, "lo", 1, 7)), (Rule("ban", "text", "llo", 9), None)])
def test_text_bans(rule, expected):
    now, met = generation(RuleSet().add(rule), "Hel", "lo", " wor", "ld")
    assert next((m for m in met if m), None) == expected


def test_rewind_and_bans_in_force():
    rules = RuleSet().ban_texts(["quick brown"])
    now, met = generation(rules, "The", " quick", " brown")
    now.rewind(met[-1][0])
    assert now.text == "The" and now.at == 1 and not now.allows(" quick") and now.allows(" fast") and not now.allows("quick brown")
    for t in (" fast", " yellow", " fox"):
        assert now.accept(t) is None
    assert now.text == "The fast yellow fox" and now.allows(" quick")
    now.rewind(99)
    assert now.text == "" and now.at == 0
    both, met = generation(RuleSet().add(Rule("ban", "tokens", ("b", "c")), Rule("ban", "text", "abc")), "a", "b", "c")
    assert met[-1][0] == 3  # the longer of both rewinds


def test_allowed_texts_and_tokens():
    texts = lambda *words: RuleSet().add(*(Rule("allow", "text", w) for w in words))
    assert [generation(texts("Hello"))[0].allows(t) for t in ("He", "H", "llo", "World")] == [True, True, False, False]
    assert generation(texts("Hello"), "He")[0].allows("llo") and generation(texts("Hello", "World"), "He")[0].allows("lloWorld")
    assert generation(texts("A", "B"), "A")[0].allows("B") and not generation(texts("A", "B"), "A")[0].allows("C") and not generation(texts("A", "AB"), "A")[0].allows("B")
    now, _ = generation(texts("AB", "AC"), "A", "B")
    now.rewind(1)
    assert now.allows("B") and now.allows("C")
    rules = RuleSet(ends=frozenset({"</s>"})).add(Rule("allow", "tokens", ("a", "b")), Rule("ban", "token", "b"))
    now, _ = generation(rules, control=frozenset({"</s>"}))
    assert now.allows("a") and not now.allows("b") and now.allows("</s>")
    now.accept("a")
    assert not now.allows("b") and now.allows("</s>")  # a ban beats an allowance
    with pytest.raises(ValueError):
        rules.add(Rule("ban", "token", "</s>"))
    with pytest.raises(ValueError):
        rules.add(Rule("ban", "tokens", ("x", "</s>")))


def test_rule_sets():
    rules = RuleSet().ban_texts(["ab", "", "c"], at=5, duration=3).add(Rule("allow", "text", "abc"))
    assert [rules.rules[0].active(n) for n in (4, 5, 7, 8)] == [False, True, True, False] and len(rules.rules) == 3
    assert rules.longest("text") == 3 and rules.longest("tokens") == 0 and len(rules.clear("ban", "text").rules) == 1 and not rules.reset().rules


def test_replay_frames(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], "x"), (2, None, "x"), (3, [], None)], "k long, t array<string>, text string")
    got = {r.k: r for r in replay(df, "k", F.col("t"), RuleSet().ban_texts(["bc"])).collect()}
    assert got[1].text == "a" and [tuple(e) for e in got[1].events] == [(2, 2, "b", 1, 3)] and got[2].text == "" and got[3].n_tokens == 0
    assert permitted(df.limit(0), "k", F.col("t"), ["a"], RuleSet()).count() == 0


def test_steps(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (i + 1)) for i in range(7)] + [(8, None), (9, "")], "id long, p string").coalesce(1)
    for continuous in (True, False):
        got = {r.id: r for r in run_steps(df, "id", "p", width=3, max_tokens=5, continuous=continuous).collect()}
        assert len(got) == 9 and got[6].response == " ".join(["w6"] * 5) and got[2].n_tokens == 3 and got[8].response == "" and not any(r.error for r in got.values())

    def failing(items):
        if any(p.startswith("w1") and len(t.split()) == 1 for p, t in items):
            raise RuntimeError("full")
        from cardloom.operators.steps import stub_step

        return stub_step(items)

    got = {r.id: r for r in run_steps(df, "id", "p", failing, width=2).collect()}
    assert len(got) == 9 and sum(r.error is not None for r in got.values()) >= 1 and all(r.error == "Inference Failed" for r in got.values() if r.error)


def test_templates(spark):
    df = spark.createDataFrame([("Mistral-Small-3.2-24B-Instruct-2506", "USER", "hi"), (None, "assistant", "yo"), ("x", "user", "")], "model string, role string, text string").withColumn("t", template_of(F.col("model")))
    got = [tuple(r) for r in df.select("t", wrapped(F.col("role"), F.col("text"), F.col("t")).alias("a"), wrapped(F.col("role"), F.col("text"), F.col("t"), before=False).alias("b")).collect()]
    assert got[0] == ("mistral", "[INST]hi[/INST]", "hi[/INST]") and got[1][:2] == ("chatml", "yo<|im_end|>\n") and got[2][1].endswith("<|im_start|>assistant\n")
    assert parse_response("<think>Q: no</think>Q: a\nQ: b\nA: c\nA: d") == [("b", "c\nA: d")] and parse_response(None) == []


CHUNKS = [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 3, 1)), (3, dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 1)), (4, None)]
LOG = [(1, "TextChunk", 3, "delete", None), (2, "TextChunk", 5, "delete", None), (3, "TextChunk", 5, "restore", None), (4, "TextChunk", 1, "update", None), (5, "FlashCard", 1, "delete", None), (6, "TextChunk", 7, "delete", None), (7, "TextChunk", 7, "restore", 8)]


def test_orphan_references(spark):
    refs = spark.createDataFrame([("f", i, k, dt.datetime(2024, 2, 2)) for i, k in enumerate([1, 2, 3, 5, 7, 8, None, 4, 2])] + [("f", 1, 2, None)], "ref_table string, row_id long, key long, at timestamp")
    chunks = spark.createDataFrame(CHUNKS, "id long, saved_at timestamp")
    log = spark.createDataFrame(LOG, "seq long, entity string, id long, op string, new_id long")
    got = sorted((r.row_id, r.kind) for r in orphan_references(refs, chunks, log).collect())
    assert got == [(1, "late"), (2, "deleted"), (3, "missing"), (4, "deleted"), (5, "missing"), (8, "late")]
    assert {r.id: r.deleted for r in chunk_states(log, "TextChunk").collect()} == {3: True, 5: False, 7: True, 8: False}
    assert orphan_references(refs.limit(0), chunks, log).count() == 0
    assert {r.kind for r in orphan_references(refs, chunks.limit(0), log.limit(0)).collect()} == {"missing"}


@pytest.mark.parametrize("match, expected", [("simple", {2}), ("partial", {2, 4}), ("full", {2, 3, 4})])
def test_orphans_by_null_mask(spark, match, expected):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", None), (4, None, 9), (5, None, None)], "n int, x string, y int")
    targets = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "x string, y int, n int")
    assert {r.n for r in orphans(refs, targets, [("x", "x"), ("y", "y")], match).collect()} == expected


def test_skew_join_with_hot_key(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(7, "hot"), (5000, "cold")], "k long, v string")
    got = skew_left_join(left, right, "k").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"hot": 4000, "cold": 1, None: 1999}


def test_store(spark):
    chunks = spark.createDataFrame([(1, "f"), (2, "f")], "id long, file_id string")
    cards = spark.createDataFrame([(10, "q", "a", 1), (11, "q", "a", 1), (12, "q", "a", 2), (13, "q", "a", None)], "id long, question string, answer string, origin_id long")
    left, kept = delete_chunks(chunks, cards, spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in left.collect()] == [2] and sorted(r.id for r in kept.collect()) == [12, 13]
    restored, moved = restore_chunks(chunks.where("id = 1"), cards.where("origin_id = 1"), 50, 99)
    assert [(r.old_id, r.id) for r in restored.collect()] == [(1, 51)]
    assert sorted((r.old_id, r.id, r.origin_id) for r in moved.collect()) == [(10, 100, 51), (11, 101, 51)]
    changed = update_cards(cards, spark.createDataFrame([(10, "Q", None), (77, "x", "y")], "id long, question string, answer string"))
    assert sorted((r.id, r.question, r.answer) for r in changed.collect()) == [(10, "Q", None), (11, "q", "a"), (12, "q", "a"), (13, "q", "a")]
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "id long, seq long, op string")
    assert [tuple(r) for r in fold_log(log, ["id"], "seq", ["op"]).collect()] == [(1, 3, "c")]


def test_details(spark):
    chunks = spark.createDataFrame([(1, "f"), (2, "f"), (2, "f")], "id long, file_id string")
    cards = spark.createDataFrame([(11, "q", "a", 1), (10, "q", None, 1), (10, "q", None, 1), (12, "q", "a", None), (13, "q", "a", 9)], "id long, question string, answer string, origin_id long")
    got = sorted((r.id, r.card_id or 0) for r in details(chunks, cards).collect())
    assert got == [(1, 10), (1, 11), (2, 0)]
    row = details_of(chunks, cards, 1).head()
    assert row.chunk.id == 1 and [c.id for c in row.cards] == [10, 11]
    row = details_of(chunks, cards, 5).head()
    assert row.chunk is None and row.cards == []
