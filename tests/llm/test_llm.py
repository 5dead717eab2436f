"""The operators for text collections against brute force, round trips and labelled cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("cardloom.llm")

from cardloom.llm.bpe import PATTERN, TOKENIZERS, Encoder, encode_column, vocabulary  # noqa: E402
from cardloom.llm import cutoff, nearcopies, sketches, spans  # noqa: E402
from cardloom.llm import defects as defects_module  # noqa: E402
from cardloom.llm.cutoff import open_structures  # noqa: E402
from cardloom.llm.defects import cut_share, defect_of, defects, is_copy, is_empty, is_other_language, is_refusal, tiled, truncated  # noqa: E402
from cardloom.llm.fmindex import FMIndex  # noqa: E402
from cardloom.llm.language import language_of  # noqa: E402
from cardloom.llm.markup import LABELLED, best_run, clean_text, cleaned, kinds_of, labelled_pages, markup_kinds, markup_regions, weights  # noqa: E402
from cardloom.llm.mixture import fit_subset, mix  # noqa: E402
from cardloom.llm.nearcopies import near_copy_groups, near_copy_pairs, needed  # noqa: E402
from cardloom.llm.pieces import oversized_pieces, split_text, utf16_length  # noqa: E402
from cardloom.llm.spans import shared_share, span_pairs  # noqa: E402
from tests.conftest import same  # noqa: E402

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
WORDS = "reservoir lattice beacon ledger glacier canvas tunnel enzyme harbor magnet orbit pigment quest ridge spindle tariff vault yield zenith anchor".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n)) + "."


# --- pieces ---


@pytest.mark.parametrize("text", ["x" * 10_000, "日" * 9000, "🧬" * 5000, "\n" * 9000, "Word and word. " * 600, "P one.\n\n" * 900, "a.B" * 3000])
def test_pieces_cover_the_text_within_the_limit(text):
    pieces = split_text(text)
    units = text.encode("utf-16-le")
    assert pieces[0][1] == 0 and pieces[-1][2] == len(units) // 2
    for content, a, b in pieces:
        assert utf16_length(content) // 4 <= 700 and units[2 * a : 2 * b].decode("utf-16-le") == content
    for (_, a, b), (_, c, d) in zip(pieces, pieces[1:]):
        assert a < c < b < d and 100 <= b - c <= 320


def test_pieces_cut_at_natural_ends():
    text = "\n\n".join("This is sentence number one. And here is two!" for _ in range(200))
    assert all(p.endswith((".", "!", "\n")) for p, _, _ in split_text(text)[:-1])
    assert split_text("short") == [("short", 0, 5)] and split_text("") == []


@pytest.mark.parametrize("n", [2400, 2503, 2590, 2699, 2750, 2801])
def test_no_cut_inside_a_paragraph_that_fits(n):
    paragraphs = [(" ".join(f"Word {i % 9} is here." for i in range(k, 220 + k))[: n - 1]).rstrip() + "." for k in range(4)]
    text = "\n\n".join(paragraphs)
    ends, at = [], 0
    for p in paragraphs:
        at += len(p) + 2
        ends.append(min(at, len(text)))
    cuts = [b for _, _, b in split_text(text)]
    assert cuts[0] == ends[0]  # the end of the first paragraph fits, so no word of the second comes before the cut
    if n <= 2590:  # with its overlap every paragraph fits a piece
        assert cuts == ends
    assert all(text[b - 1].isspace() or b == len(text) for b in cuts)  # at sentence ends and better


def test_pieces_of_random_texts():
    rng = random.Random(11)
    for _ in range(25):
        text = "".join(rng.choice(["word ", "A sentence ends. ", "\n\n", "\n", "x" * rng.choice([1, 50, 3000]), "日本。", "🧬", "# H\n"]) for _ in range(rng.randrange(200, 900)))
        pieces, units = split_text(text), text.encode("utf-16-le")
        assert pieces[0][1] == 0 and pieces[-1][2] == len(units) // 2
        assert all(utf16_length(c) // 4 <= 700 and units[2 * a : 2 * b].decode("utf-16-le") == c for c, a, b in pieces)
        assert all(a < c < b < d and (100 <= b - c <= 302 or b - a <= 302) for (_, a, b), (_, c, d) in zip(pieces, pieces[1:]))


def test_pieces_frame(spark, duck, data):
    df = spark.createDataFrame([(1, "w " * 2000, 5, "x"), (1, "w " * 2000, 5, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (4, "z" * 2803, None, "x"), (5, "z" * 2804, None, "x")], "id long, content string, start_position int, piece string")
    rows = oversized_pieces(df).orderBy("id", "piece").collect()
    assert {r.id for r in rows} == {1, 5} and rows[0].start_position == 5 and [r.piece for r in rows if r.id == 5] == [0, 1]
    assert oversized_pieces(df.limit(0)).count() == 0
    from cardloom.llm import queries_text

    same(queries_text.QUERIES["p1_found"](spark, data), duck, queries_text.SQL["p1_found"])


# --- token ids ---


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*vocabulary(PATH))


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(vocabulary(PATH)[0]) if t}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_encoder(encoder, public):
    rng = random.Random(1)
    parts = ["ab", "the", "in", " ", "\n", "é", "日本", "a" * 9, "01", "!", "-=", "ing", "🧬", "<|endoftext|>", "\x00", "\u200b", "'s", "\t"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == public.encode_ordinary(text)
    for text in ("x" * 40_000, "日" * 5000):
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == public.encode_ordinary(text)


def test_ids_of_documents(spark, data, public):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").withColumnRenamed("lang", "ids")
    rows = encode_column(df, ["doc_id"], "text", "ids").join(df.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == df.count() and all(r.ids == public.encode_ordinary(r.text or "") for r in rows)
    assert encode_column(df.limit(0), ["doc_id"], "text", "ids").count() == 0


# --- mixture ---


def test_subset_sums_are_optimal():
    rng = np.random.default_rng(2)
    for k in range(300):
        sizes = np.unique(rng.integers(1, 60, 6)) * (2 if k % 5 == 0 else 1)
        counts = rng.integers(0, 5, len(sizes))
        if not counts.sum():
            continue
        budget = int(rng.integers(0, (sizes * counts).sum() + 20))
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + int(s) * j for r in reach for j in range(c + 1)}
        taken = fit_subset(sizes, counts, budget, window=int(rng.integers(1, 300)))
        assert (taken >= 0).all() and (taken <= counts).all()
        assert int((sizes * taken).sum()) == max(r for r in reach if r <= budget)
    big = fit_subset(np.array([7, 500, 9000]), np.array([10**6, 10**5, 10**4]), 31_234_567)
    assert int((np.array([7, 500, 9000]) * big).sum()) == 31_234_567
    even = fit_subset(np.array([4, 6]), np.array([10**6, 10**6]), 4_000_001)
    assert int((np.array([4, 6]) * even).sum()) == 4_000_000


@pytest.mark.parametrize("n", [300, 3000])
def test_fit_subset_takes_all_lengths_alike(n):
    rng = np.random.default_rng(n)
    lengths = np.maximum(1, rng.gamma(2, 150, n).astype(int))
    sizes, counts = np.unique(lengths, return_counts=True)
    budget = int(lengths.sum()) * 2 // 5
    taken = fit_subset(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all() and (sizes * taken).sum() == budget
    # two fifths of the tokens are about two fifths of the documents, also where most lengths have one document
    assert abs(taken.sum() / n - 0.4) < 0.02
    mixed = rng.permutation(len(sizes))
    assert (fit_subset(sizes[mixed], counts[mixed], budget) == taken[mixed]).all()  # whatever order the lengths come in


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(3, 30)), "big" if i % 3 else "small") for i in range(300)] + [(900, None, "big"), (901, "", "big"), (902, "x y", "other"), (903, "tiny words here", "tiny")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("tiny", 0.05, 2), ("none", 0.05, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = mix(documents, targets, strict=False)
    got, told = mixture.collect(), {r.source: r for r in shares.collect()}
    assert {r.source for r in got} == {"big", "small", "tiny"} and not {900, 901, 902} & {r.doc_id for r in got}
    assert len({r.doc_id for r in got}) == len(got)
    for source, most in (("big", 2), ("small", 3), ("tiny", 2)):
        used = [r for r in got if r.source == source]
        assert max(r.copies for r in used) <= most and sum(r.n_tokens * r.copies for r in used) == told[source].used_tokens
    assert told["big"].short_tokens == 0 == told["small"].short_tokens and told["tiny"].short_tokens > 0 and told["none"].used_tokens == 0
    assert abs(sum(r.reached_share for r in told.values()) - 1) < 1e-9
    assert sorted(map(tuple, mix(documents, targets, strict=False)[0].collect())) == sorted(map(tuple, got))
    mixture, shares = mix(documents, targets)
    used, told = {}, {r.source: r for r in shares.collect()}
    for r in mixture.collect():
        used[r.source] = used.get(r.source, 0) + r.n_tokens * r.copies
    assert told["none"].used_tokens == 0 and told["none"].short_tokens > 0
    for source in ("big", "small", "tiny"):  # every share is reached but for what no document is small enough for
        assert told[source].short_tokens <= 2 and used[source] == told[source].used_tokens
        assert abs(told[source].reached_share * 0.95 - told[source].target_share) < 0.02
    assert mix(documents.limit(0), targets)[0].count() == 0


# --- markup ---


@pytest.mark.parametrize("text, kinds", LABELLED)
def test_labelled_pages(text, kinds):
    assert kinds_of(text) == kinds.split()


@pytest.mark.parametrize("text, kinds", [("<b>x", "html"), ("a <script>var s = 1", "html"), ("```py\nx\n\nthen <i>y</i>", "html markdown"), ("[[a|b", "wiki"), ("{{cite|x", "wiki"), ("\\begin{equation}\n p = 2", "latex"), ("5 < 6 and 7 > 3", ""), ("a_b_c * d", ""), ("<EM>loud</EM> words", "html"), ("</P", "html"), ("so $" + " + ".join(f"x_{i}" for i in range(60)) + "$ holds", "latex"), ("thus $y = \\frac{1}{2", "latex"), ("", ""), (None, "")])
def test_cut_off_markup(text, kinds):
    assert kinds_of(text) == kinds.split()


def test_weights_on_held_out_pages():
    """Pages of another seed: which passage holds what, told by the regions of the whole page."""
    right = found = true = 0
    for text, spans in labelled_pages(300, seed=77):
        want, got = {k for *_, kinds in spans for k in kinds.split()}, set(kinds_of(text))
        right, found, true = right + len(want & got), found + len(got), true + len(want)
    assert right >= 0.98 * true and right >= 0.98 * found
    assert weights()["word"] > 0 and all(weights()[f"{k}.{f}"] < 0 for k, f in (("html", "tag"), ("markdown", "strong"), ("wiki", "link"), ("latex", "environment")))


def test_best_run_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.uniform(-3, 2) for _ in range(rng.randrange(1, 14))]
        best = max([sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)] + [0.0])
        assert abs(best_run([(i, i + 1, x) for i, x in enumerate(scores)])[2] - best) < 1e-9
    text = "plain words here <b>bold</b> and more plain words until $x_1 = 2$ ends"
    a, b = markup_regions(text)["html"]
    assert text[a:b].startswith("<b>") and set(markup_regions(text)) == {"html", "latex"}


def test_clean_text_keeps_structure():
    page = "<h2>Head</h2><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre><code>x = 1\n  y</code></pre><p>One &amp; two</p><script>bad()</script>"
    got = clean_text(page)
    assert "## Head" in got and "- a\n- b" in got and "1 | 2" in got and "x = 1\n  y" in got and "One & two" in got and "bad" not in got
    assert clean_text("# T\n\n- [x] a\n**b** and `c`\n") == "# T\n\n- a\nb and c"
    assert clean_text("== T ==\n'''b''' [[x|y]] {{z|1}} ok") == "## T\nb y  ok"
    assert clean_text("\\section{T} \\textbf{b} costs 5\\% and $x^2$ \\item q") == "# T b costs 5% and $x^2$ - q"
    assert clean_text("Dear {{name}}, see {{cite|x}}''''it''''.") == "Dear name, see it."
    long = "$" + " + ".join(f"\\frac{{a_{i}}}{{b}}" for i in range(40)) + "$"
    assert clean_text(f"So {long} holds \\textbf{{here}}.") == f"So {long} holds here."
    for plain in ("It costs $5 to $9, see #4.", "C:\\a\\b.txt", "x < 2\n- a\n- b", None, ""):
        assert clean_text(plain) == plain


def test_markup_frames(spark):
    df = spark.createDataFrame([(1, "<p>a", "k"), (1, "<p>a", "k"), (2, None, "k"), (3, "", "k"), (4, "plain", "k"), (None, "<p>", "k")], "id long, content string, markup string")
    assert [tuple(r) for r in markup_kinds(df).collect()] == [(1, "html")]
    assert {r.id: r.content for r in cleaned(df).collect()} == {1: "a", 2: None, 3: "", 4: "plain"}
    assert markup_kinds(df.limit(0)).count() == 0


# --- defects ---


@pytest.mark.parametrize("answer", [None, "", " \n", "\u200b", "...", "?", "N/A", "null", "(none)", "TBD", "A:", "—"])
def test_empty(answer):
    assert is_empty(answer)


def test_copies():
    q = "What does a peimisk do to the rigid tunnel?"
    for a in (q, q.lower()[:-1], f"A: {q}", f"“{q}”", "Rigid tunnel, what does a peimisk do to the?"):
        assert is_copy(q, a)
    assert not is_copy(q, "A peimisk lines the rigid tunnel with a resin that hardens.") and not is_copy(None, "x") and not is_copy(q, "the rigid tunnel")
    assert tiled("abcd", "cdab") == 4 and tiled("abcd", "dcba") == 0 and tiled("abcabc", "abc") == 3


def test_copies_that_repeat_the_question():
    q = "What if the slow harbor of gliglarl fails in Staevyrnlath?"
    for a in (f"{q} {q}", f"{q}\n{q}\n{q}", " ".join([q] * 40), f"{q} {q[:30]}", f"{q} {q.replace('Staevyrnlath', 'Staevyrnlaht')}"):
        assert is_copy(q, a)
    ja = "港の弁が止まるとどうなりますか？"
    assert is_copy(ja, ja * 3)
    assert not is_copy(q, "The " * 30) and not is_copy(q, f"{q} It floods the lower lattice until the anchor is set and the tariff is paid.")


def test_refusals():
    for a in ("I'm sorry, but I cannot help with that.", "No flash card can be produced for x.", "Leider darf ich Fragen dazu nicht beantworten.", "Je ne peux pas répondre.", "Lo siento, pero no puedo.", "申し訳ありませんが、お答えできません。"):
        assert is_refusal(a)
    for a in ('It says "I cannot take it", so they send a signal.', "It cannot hold the engine, so the operator declines the request.", "The valve is not able to close."):
        assert not is_refusal(a)


def test_languages():
    assert language_of("Die Achse wird nicht von der Feder getragen.")[0] == "de" and language_of("税が冷えると、塔を測る。")[0] == "ja"
    assert is_other_language("How is the rhythm related to the tunnel?", "La pluma pesada estabiliza la tasa después de 58 minutos.")
    assert not is_other_language("What is the Spanish phrase for x?", "la tasa de la pluma y su ruta después") and not is_other_language(None, "x")


def test_open_structures():
    assert open_structures('a (b [c "d') == ["(", "[", '"'] and open_structures("(a) [b] “c” 1) it's") == [] and open_structures("```\nx = (") == ["```"]


def answers(rng):
    """Whole answers of several forms, and cut ones."""
    whole, cut = [], []
    for _ in range(700):
        a, b, c = (rng.choice(WORDS) for _ in range(3))
        forms = [f"The {a} guards the {b} of every {c}.", f"The {a} {b}, near {c.title()}", f"{a}, {b} and {c}", f"- the {a} of {b}\n- the {c} of {a}\n- the {b} of {c}", f"x = {rng.randrange(9)} * k + {rng.randrange(99)}", f"When the {a} cools, the {b} counts its {c} within 5 days. Most {c} designs use a {a}."]
        text = rng.choice(forms)
        if rng.random() < 0.15 and "." in text and len(text) > 40:
            cut.append(text[: rng.randrange(25, len(text) - 6)])
        else:
            whole.append(text)
    return whole, cut


def test_truncation_on_held_out_answers(spark):
    whole, cut = answers(random.Random(4))
    rows = [(i, "What of it?", a, "p") for i, a in enumerate(whole)] + [(10_000 + i, "What of it?", a, None) for i, a in enumerate(cut)] + [(-1, None, None, "p"), (-2, "q", "", "p"), (-3, "q", "ends in (an open", "p")]
    df = spark.createDataFrame(rows, "id long, question string, answer string, preset string")
    found = {r.id for r in truncated(df).collect()}
    hits = sum(i >= 10_000 for i in found)
    assert hits >= 0.9 * len(cut) and sum(0 <= i < 10_000 for i in found) <= 0.02 * len(whole) and -3 in found and not {-1, -2} & found
    told = {r.id: r.defect for r in defects(df.unionByName(df.limit(3))).collect()}
    assert {i for i, d in told.items() if d == "truncated"} == found and told[-1] == told[-2] == "empty"
    shares = {r.preset: r for r in cut_share(df, "preset").collect()}
    assert shares[None].n_cut == hits and shares["p"].n_answers == len(whole) + 1
    assert truncated(df.limit(0)).count() == 0 and defects(df.limit(0)).count() == 0
    assert defect_of("q", "x y z", True) == "truncated"


def test_marks_that_end_no_sentence(spark):
    whole, _ = answers(random.Random(9))
    whole = [a for a in whole if a.endswith(".")] + [f"The {a} holds at {i % 40}.{i % 9} volts." for i, a in enumerate(WORDS * 5)] + [f"The step (approx. {i % 7} turns) closes the {a}." for i, a in enumerate(WORDS * 3)]
    cut = ["The beacon is cold. It is listed under No.", "Compare the quest vs.", "It holds for several cases, e.g.", "1. the vault\n2. the quest\n3.", "The vault (see the quest.", 'He said "the vault is cold.', "The beacon holds at 33.", "The step closes approx.", "The canvas guards the latt…"]
    fine = ["The answer is no.", "No.", "The vault, the quest, and so on…", "1. the vault\n2. the quest.", "It guards the vault (and the quest, etc.)", "..."]
    df = spark.createDataFrame([(i, "What of it?", a, "p") for i, a in enumerate(cut + fine + whole)], "id long, question string, answer string, preset string")
    assert {r.id for r in truncated(df).collect()} == set(range(len(cut)))
    assert {r.id for r in defects(df).collect() if r.defect == "truncated"} == set(range(len(cut)))


def test_counts_are_exact(spark):
    """Many distinct words leave the counts of a word that occurs once where they are, and rare contexts are dropped."""
    texts = [" ".join(f"{a}{b}{chr(97 + i % 26)}" for a in WORDS for b in ("al", "eg", "is", chr(97 + i // 26 % 26) + chr(97 + i // 676 % 26))) + "." for i in range(3000)] + ["zyxwv"]
    df = spark.createDataFrame([(i, None, t, i) for i, t in enumerate(texts)], "id long, question string, answer string, row long")
    told = df.mapInArrow(defects_module._read(True), defects_module.READ)
    known = cutoff.trusted(told.where("id is null").select("kind", "key", "n", "yes", "over")).where(F.col("kind") == cutoff._WORD)
    got = {r.key: r.n for r in known.collect()}
    counted = Counter(w for t in texts for w in re.findall(r"\w+", t))
    assert got == {cutoff._place("word", w): n for w, n in counted.items() if n > cutoff.EVIDENCE}


def test_sentences_have_keys_of_their_own():
    """The key of all of the sentence so far, computed over many texts at once, is that of the text alone."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["The", "a", "cat", "3.", "No.", "it ends.", "line\nnext", "x, y"]) for _ in range(rng.randrange(1, 90))) for _ in range(900)]
    whole = cutoff.ValueTexts(texts, ["en"] * len(texts))
    for i in rng.sample(range(len(texts)), 60):
        alone = cutoff.ValueTexts([texts[i]], ["en"])
        assert [int(x[i]) for x in whole.contexts(whole.token_ends)] == [int(x[0]) for x in alone.contexts(alone.token_ends)]
    one, other = (cutoff.ValueTexts([t], ["en"]).contexts for t in ("He ran. The a", "It sat! The a"))
    ends = [cutoff.ValueTexts([t], ["en"]).token_ends for t in ("He ran. The a", "It sat! The a")]
    assert one(ends[0])[-1] == other(ends[1])[-1]  # after a sentence's end only the new sentence counts


@pytest.mark.parametrize("language", ["en", "de", "fr", "es"])
def test_no_refusal_is_left_out_before_its_grammar(language):
    """The words asked for first are in every match of the grammars."""
    pattern = re.compile(defects_module._REFUSALS[language].pattern, re.I | (re.X if language == "en" else 0))

    @settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def check(text):
        if defects_module._REFUSALS[language].search(text):
            assert language in defects_module.may_refuse(set(defects_module.words_of(text.replace("ſ", "s"))))

    check()


def test_former_cuts_are_gone():
    for a in ("Sorry.\nI cannot answer this question.", "(I cannot provide that)", "Unfortunately,\nI cannot help here.", "The passage isnt educational.", "The text is\nnot educational.", "No\nflashcards can be made from this."):
        assert is_refusal(a)
    q = "What is osmosis and why does it matter here?"
    assert is_copy(q, ", ".join(q.split())) and is_copy(q, " ... ".join(q.split()))
    assert is_other_language("What is the film about?", "La película Under the Sea es la que trata de los peces y de las algas en el mar.")
    assert is_empty("«" + " . " * 40 + "» N/A") and not is_empty("no answer is known to this day by anyone at all")


@pytest.mark.parametrize("text", ['He said "we must go now.', "```py x = 1.", "as shown (see figure 2.", "the sum $x + 1", "\\begin{align} a = b.", "<b>one</b> and <b>two", "it is **strong", "- one\n-", "1. one\n2. two\n3.", "\\(x + y"])
def test_structures_left_open(text):
    assert open_structures(text)


@pytest.mark.parametrize("text", ["It costs $5 to $9.", "a < b and c > d", "2 ** 3", "- one\n- two", "1) first", "<b>x</b> and $y$ in \\begin{a}z\\end{a} **k**", "The <id> of it", "", "<p>open paragraph"])
def test_structures_closed(text):
    assert not open_structures(text)


# --- near copies ---


def brute_pairs(rows):
    sets = {i: Counter(re.findall(r"[^\W_]+", f"{q or ''} {a or ''}".lower())) for i, q, a in rows}
    out = set()
    for i in sets:
        for j in sets:
            if i < j and (total := sets[i].total() + sets[j].total()):
                common = (sets[i] & sets[j]).total()
                if common and 10 * common >= 7 * (total - common):
                    out.add((i, j))
    return out


def edited(rng, text):
    words = text.split()
    for _ in range(rng.randrange(0, 5)):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [words[k], words[k]], [words[k][:-1]]])
    if rng.random() < 0.3:
        rng.shuffle(words)
    return " ".join(words)


@pytest.mark.parametrize("vocabulary_size", [3, 400])
def test_near_copies_equal_brute_force(spark, vocabulary_size):
    rng, rows = random.Random(5 + vocabulary_size), []
    for _ in range(45):
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(vocabulary_size)) for _ in range(rng.choice([2, 6, 9, 12, 25, 38, 45, 90])))
        rows += [(len(rows) + k, "Why is it?", edited(rng, base)) for k in range(rng.randrange(1, 5))]
    rows += [(1000 + i, None, "the very same words") for i in range(30)] + [(2000, None, None), (2001, "", "?"), (2002, "Same VERY, the", "words!")]
    df = spark.createDataFrame(rows + rows[:5], "id long, question string, answer string")
    got = [tuple(r) for r in near_copy_pairs(df, ["question", "answer"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    degree = Counter(x for p in got for x in p)
    groups = near_copy_groups(df, ["question", "answer"]).collect()
    assert {r.id for r in groups} == {i for i, q, a in rows if re.search(r"[^\W_]", f"{q or ''}{a or ''}")}
    assert all(r.n_links + r.n_copies - 1 == degree[r.id] for r in groups)


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([], "id long, question string, answer string")
    assert near_copy_pairs(df, ["question", "answer"]).count() == 0
    # the most bits in which 28 words can differ from 20 to 28 others at 0.7, and one more
    most = max(28 + n - 2 * o for n in range(20, 29) for o in range(n + 1) if 10 * o >= 7 * (28 + n - o))
    assert needed(28, 1) == most + 1 and needed(9, 1) == 0


# --- spans ---


def test_index_places_near_the_beginning_of_a_text():
    rng = np.random.default_rng(9)
    for last in (False, True):  # the first text sorts before or behind the others
        texts = [np.concatenate(([4 if last else 1], rng.integers(2, 4, 20)))] + [rng.integers(2, 4, n) for n in (9, 14, 11, 13, 9, 10)]
        text = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int32)
        index = FMIndex(text)
        for pattern in {tuple(text[i : i + 3]) for i in range(len(text) - 3)}:
            if 0 not in pattern:
                got = np.sort(index.locate(*index.search(np.array([pattern])))[0])
                assert got.tolist() == [i for i in range(len(text) - 2) if tuple(text[i : i + 3]) == pattern]


def test_index_equals_scan():
    rng = np.random.default_rng(6)
    text = rng.integers(1, 5, 2000).astype(np.int32)
    text[::400] = 0
    index = FMIndex(text)
    patterns = np.stack([text[i : i + 8] for i in range(1, 1900, 13)] + [rng.integers(1, 5, 8) for _ in range(100)])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        where = [i for i in range(len(text) - 7) if (text[i : i + 8] == p).all()] if (p > 0).all() else []
        assert sorted(index.places_of(np.arange(a, b)).tolist()) == where


@pytest.mark.parametrize("hot, hashes", [(256, 1_000_000), (2, 1_000_000), (2, 0)])
def test_spans_equal_brute_force(spark, monkeypatch, hot, hashes):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "HOT_HASHES", hashes)
    rng = random.Random(7)
    long = lambda n: " ".join(sentence(rng) for _ in range(n))
    shared, texts = [long(9) for _ in range(6)], {}
    for i in range(40):
        texts[i] = long(rng.randrange(1, 5))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) - 260)
            piece = s[a : a + rng.choice([150, 199, 200, 201, 260, 600])]
            at = rng.randrange(len(texts[i]))
            texts[i] = texts[i][:at] + piece + texts[i][at:]
    texts |= {50: texts[0], 51: texts[0], 52: "ab" * 400, 53: "ab" * 300 + "c", 54: "", 55: None, 56: "日本語" * 90 + "x", 57: "y" + "日本語" * 80}
    rows = [(i, t, i) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash long")
    runs = {i: {t[k : k + 200] for k in range(len(t) - 199)} for i, t in texts.items() if t}
    true = {(i, j) for i in runs for j in runs if i < j and runs[i] & runs[j]}
    got = [tuple(r) for r in span_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == true and (0, 50) in true
    told = {r.doc_id: r for r in shared_share(df).collect()}
    for i, t in texts.items():
        marked = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - 199):
            if any(t[k : k + 200] in runs[j] for j in runs if j != i):
                marked[k : k + 200] = True
        assert told[i].shared_chars == marked.sum()
    assert span_pairs(df.limit(0)).count() == 0 and told[55].n_chars is None and told[54].shared_share == 0


def test_registered_queries_run(spark, data):
    from cardloom.llm import query_modules

    for module in query_modules():
        for name, query in module.QUERIES.items():
            df = query(spark, data)
            assert df.columns and df.count() >= 0, name


def test_records_without_enough_partitions(spark, monkeypatch):
    """Records of very few common words ask for their rarest bits, and find all."""
    rng = random.Random(12)
    rows = [(i, "", " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randrange(6, 40)))) for i in range(120)]
    df = spark.createDataFrame(rows * 1, "id long, question string, answer string")
    monkeypatch.setattr(nearcopies, "RARE_RECORDS", 1)
    assert {tuple(r) for r in near_copy_pairs(df, ["question", "answer"]).collect()} == brute_pairs(rows)


def test_whole_hashes_decide_where_half_ones_leave_doubt(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, "", " ".join(rng.choice(WORDS) for _ in range(12))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    monkeypatch.setattr(nearcopies, "AMBIGUOUS", -1)  # all pairs are in doubt
    assert {tuple(r) for r in near_copy_pairs(df, ["question", "answer"]).collect()} == brute_pairs(rows)


def test_sketches_of_many_tasks(spark):
    counts = spark.range(0, 300, 1, 150).mapInPandas(lambda batches: (sketches.chunks(np.bincount(b["id"], minlength=70_000), 3) for b in batches), sketches.COUNTS)
    got = sketches.summed(counts)
    assert set(got) == {3} and got[3].sum() == 300 and (got[3][:300] == 1).all()
    bits = spark.range(0, 300, 1, 150).mapInPandas(lambda batches: (sketches.bit_chunks(np.bincount(b["id"], minlength=1 << 12) > 0) for b in batches), sketches.COUNTS)
    assert np.unpackbits(sketches.united(bits, [1 << 12, 64])[0])[:301].sum() == 300
