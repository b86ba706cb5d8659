"""Cut texts: limits found in the right measure, cuts of every kind, complete endings left alone."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from gridloom.llm.truncation import FREQUENT, RATE, character_counts, ending, find_truncated, length_limits, length_measures, truncation_by_source, verdict, with_at_limit

RNG = random.Random(5)
NOUNS = ["harbour", "lantern", "meadow", "signpost", "causeway", "elevation", "märkte", "cañada"]
DDL = "doc_id bigint, source string, text string, author string, measure string, value int"


def post(rng, sentences):
    return " ".join(f"The {rng.choice(NOUNS)} <crossed> every \"{rng.choice(NOUNS)}\" beside that {rng.choice(NOUNS)} & the {rng.choice(NOUNS)}.\n" for _ in range(sentences)).strip()


def corpus():
    rng = random.Random(1)
    rows, cut, i = [], set(), 0
    limits = {"bytes": lambda t: t.encode()[:400].decode(errors="ignore"), "chars": lambda t: t[:300], "none": lambda t: t}
    for s, limit in limits.items():
        for _ in range(400):
            full = post(rng, rng.randint(1, 9)) + rng.choice(("", "\nthanks", "\n-- \nrusty_otter7\nstill lost near that meadow"))
            kept = limit(full)
            if s == "none" and rng.random() < 0.1:
                kept = full[: rng.randint(30, len(full) - 1)]
                if len(full) - len(kept) < 60:
                    kept = full
            rows.append((i, s, kept, "rusty_otter7", "m", 1))
            if kept != full:
                cut.add(i)
            i += 1
    return rows, cut


def test_limits_and_cuts(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, DDL).repartition(3)
    limits = {(r.source, r.measure, r.value) for r in length_limits(df, "text", "source").collect()}
    assert {("bytes", "utf8", 400), ("chars", "chars", 300)} <= limits and not any(s == "none" for s, *_ in limits)
    found = {r.doc_id for r in find_truncated(df).where("cut is not null").collect()}
    texts = {r[0]: r[2] for r in rows}
    at_stop = {i for i in cut if texts[i].rstrip()[-1:] in ".\""}
    assert len(found & cut) >= 0.97 * len(cut - at_stop)
    assert len(found - cut) <= 0.02 * len(rows)
    by = {r.source: (r.n_docs, r.n_cut) for r in truncation_by_source(find_truncated(df)).collect()}
    assert sum(n for n, _ in by.values()) == len(rows) and sum(c for _, c in by.values()) == len(found)


def test_measures(spark):
    import html
    import json

    texts = ["", "plain", "<a href=\"x\">ä & ö</a>\n", "tab\tquote\" back\\ \r\nnext\n", "emoji 😀 'x'"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", *(c.alias(m) for m, c in length_measures(df.text).items())).collect():
        t = r.text
        assert (r.chars, r.utf8, r.utf16) == (len(t), len(t.encode()), len(t.encode("utf-16-le")) // 2)
        assert (r.html, r.html_apos) == (len(html.escape(t, quote=False).replace('"', "&quot;")), len(html.escape(t)) - t.count("'"))
        assert (r.json, r.json_ascii) == (len(json.dumps(t, ensure_ascii=False)) - 2, len(json.dumps(t)) - 2)
        assert (r.crlf, r.lf) == (len(t.replace("\r\n", "\n").replace("\n", "\r\n")), len(t.replace("\r\n", "\n")))


WORDS = {"meadow": (100, 40), "wait": (50, 10), "the": (5000, 0), "near": (900, 1)}
SUFFIXES, CLOSINGS, LINKS = {"our", "ern"}, {"thanks", "+#"}, {"ka://a.a/a/9"}


def whole(word):
    n, final = WORDS.get(word, (0, 0))
    return word == "" or final > RATE * n or (n < FREQUENT and word[-3:] in SUFFIXES)


def cut_off(text, author, at_limit):
    """The verdict by what is known here."""
    from pyspark.sql import SparkSession

    rule, asked, word, last = ending(text, author)
    known = asked in LINKS or bool(last and asked and asked[0] == "l" and last[-1].lower().replace("+1", "+#") in CLOSINGS)
    word = "?" if word is None else word
    midway = not whole(word) and WORDS.get(word, (0, 0))[0] >= FREQUENT
    return SparkSession.getActiveSession().range(1).select(verdict(F.lit(rule), *map(F.lit, (at_limit, known, whole(word), midway)))).first()[0]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("It stops in the mead", "word"), ("It stops after the", "word"), ("It stops at a meadow", "sentence"), ("A broken char \ufffd", "character"), ("An entity &am", "entity"), ("<p>A tag.</", "tag"), ("A quote.[/quo", "tag"),
        ("See http://muddy.inva", "link"), ("The mea…", "mark"), ("The mea [...]", "mark"), ("The mea...", "mark"), ("Done.\n-- \nrusty_ot", "signature"), ("Done.\n~ rusty_ot", "signature"), ("EDIT: it was the", "word"), ("Done.\n> quoted near the", "word"),
    ],
)
def test_cut(spark, text, kind):
    assert cut_off(text, "rusty_otter7", False) == kind
    assert cut_off(text + " \r\n", "rusty_otter7", False) == kind


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  \n", "A sentence.", "Really?!", "He said \"no.\"", "<p>A sentence.</p>", "Wait...", "A meadow...", "Text.\nthanks", "Text.\nThanks", "+1", "[deleted]", "Text :)", "Text ;-)", "Text.\n~ rusty_otter7 ~", "Text.\n-- \nrusty_otter7",
        "Text.\n-- \nstill lost near a harbour", "Text.\nhttp://muddy.invalid/t/1234", "EDIT: found the meadow", "Text.\n> a quoted meadow", "I <3",
    ],
)
def test_complete(spark, text):
    assert cut_off(text, "rusty_otter7", False) is None


def test_at_a_limit_only_finished_endings_count(spark):
    for text in ("EDIT: found the meadow", "Text.\n-- \nstill lost near a harbour", "A meadow...", "one word"):
        assert cut_off(text, "x", True) is not None
    assert cut_off("A sentence.", "x", True) is None


def test_long_endings_are_read_whole(spark):
    """Tags, lines and texts of any length; nothing is looked at by a window of characters."""
    assert cut_off(f'Text. <a href="{"x" * 5000}', "a", False) == "tag"
    assert cut_off(f'Text. <img src="{"x" * 5000}" alt="{"y" * 900}', "a", False) == "tag"
    assert cut_off(f'Text. [url={"x" * 5000}', "a", False) == "tag"
    assert cut_off(f"Text.\n-- \n{'rusty ' * 900}the", "a", False) == "signature"
    assert cut_off("the " * 9000 + "mead", "a", False) == "word"
    assert cut_off("A sentence." + "</p>" * 4000, "a", False) is None
    assert cut_off("It was 3 < 4, and the meadow was > 5.", "a", False) is None
    assert cut_off("a <b and then it went on to the end.", "a", False) is None


def test_awkward_tables(spark):
    df = spark.createDataFrame([(1, None, None, None, "m", 1), (None, None, "", "a", "m", 1), (2, "s", "x" * 200_000, None, "m", 1), (3, "s", "Fine.", "a", "m", 1), (3, "s", "Fine.", "a", "m", 1)], DDL)
    got = Counter((r.doc_id, r.cut) for r in find_truncated(df).collect())
    assert got[3, None] == 2 and got[1, None] == 1 and got[None, None] == 1 and sum(got.values()) == 5
    assert find_truncated(df.limit(0)).count() == 0


def test_copies_do_not_teach_their_cut_end(spark):
    rng = random.Random(4)
    cut = {"p": "Gestern am Hafen gewesen.\nAlles ruhig und dann ging es zur Brück", "q": "The ferry was full so we walked back to the quaysi"}
    rows = [(i, "s", post(rng, 4) + "\n" * (i % 7 + 1) + ("bis dann allerseits" if i % 9 == 0 else "It ends here."), f"a{i % 50}", "m", 1) for i in range(600)]
    rows += [(1000 + i, f"s{i % 4}", cut[k], f"a{i}", "m", 1) for k, first in (("p", 0), ("q", 200)) for i in range(first, first + 200)]
    found = {r.doc_id for r in find_truncated(spark.createDataFrame(rows, DDL).repartition(3)).where("cut is not null").collect()}
    assert found == {1000 + i for i in range(400)}


def ramble(rng, words):
    letters = "aeinrst" * 5 + "äé"
    return "".join("".join(rng.choices(letters, k=rng.randint(1, 11))) + rng.choice((" ", " ", " ", " \"", " & ", ".\n")) for _ in range(words)).strip()


def test_copies_are_no_limit_and_hide_none(spark):
    rng = random.Random(6)
    whole = "It ends at the harbour, and then we waited there for the long winter..."
    rows = [(i, "s", ramble(rng, rng.randint(4, 200)).encode()[:400].decode(errors="ignore"), "a", "m", 1) for i in range(400)]
    rows += [(1000 + i, "s", whole + " " * (i % 2), "a", "m", 1) for i in range(900)]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    limits = {(r.measure, r.value) for r in length_limits(df, "text", "source").collect()}
    assert ("utf8", 400) in limits and all(m == "utf8" and v in (399, 400) for m, v in limits)
    assert not any(r.doc_id >= 1000 for r in find_truncated(df).where("cut is not null").collect())


def test_limits_in_two_measures(spark):
    rng = random.Random(7)
    cut = [lambda t: t.encode()[:400].decode(errors="ignore"), lambda t: t[:700]]
    rows = [(i, "s", cut[i % 2](ramble(rng, rng.randint(4, 250))), "a", "m", 1) for i in range(900)]
    limits = {(r.measure, r.value) for r in length_limits(spark.createDataFrame(rows, DDL), "text", "source").collect()}
    assert {("utf8", 400), ("chars", 700)} <= limits and limits <= {("utf8", 399), ("utf8", 400), ("chars", 699), ("chars", 700)}


def test_null_source_knows_all_limits(spark):
    limits = spark.createDataFrame([("a", "utf8", 90), ("b", "chars", 70), ("b", "html", 120), (None, "chars", 80)], "source string, measure string, value int")
    texts = {"utf8": "ä" * 45, "chars": "x" * 70, "html": "&" * 24, "own": "x" * 80, "none": "x" * 75}
    df = spark.createDataFrame([(k, s, t) for k, t in texts.items() for s in ("a", "b", "c", None)], "k string, source string, text string")
    df = df.select("k", "source", *(c.alias(n) for n, c in character_counts(F.col("text")).items()))
    got = {(r.k, r.source) for r in with_at_limit(df, limits).where("at_limit").collect()}
    assert got == {("utf8", "a"), ("utf8", None), ("chars", "b"), ("chars", None), ("html", "b"), ("html", None), ("own", None)}
    assert with_at_limit(df, limits.limit(0)).where("at_limit").count() == 0


def test_null_source_is_cut_at_the_limit_of_another(spark):
    rng = random.Random(8)
    rows = [(i, "s", ramble(rng, rng.randint(4, 200))[:400], "a", "m", 1) for i in range(400)]
    text = ("It ends at the harbour, and then we waited there. " * 9)[: 400 - len(" then harbour...")] + " then harbour..."
    rows += [(1000, None, text, "a", "m", 1), (1001, None, text[9:], "a", "m", 1)] + [(2000 + i, None, "They left the harbour.", "a", "m", 1) for i in range(50)]
    found = {r.doc_id for r in find_truncated(spark.createDataFrame(rows, DDL)).where("cut is not null").collect()}
    assert 1000 in found and 1001 not in found


def test_fragments_before_dots_are_no_words(spark):
    rng = random.Random(3)
    rows = [(i, "s", post(rng, rng.randint(1, 9)), "a", "m", 1) for i in range(400)]
    rows += [(1000 + i, "s", post(rng, rng.randint(1, 9)) + " Then on to the quaysi...", "a", "m", 1) for i in range(10)]
    found = {r.doc_id: r.cut for r in find_truncated(spark.createDataFrame(rows, DDL)).where("cut is not null").collect()}
    assert found == {1000 + i: "mark" for i in range(10)}


def test_every_word_is_judged_by_its_own_uses(spark):
    """However large the corpus: no share of all words decides which words are known."""
    rng = random.Random(12)
    rows = [(i, "s", post(rng, 8) + " It was at the gantry. The gantry stood there.", "a", "m", 1) for i in range(50)]
    rows += [(i, "s", f"{post(rng, 2)} The quay of stone {i} was old.", "a", "m", 1) for i in range(50, 110)]
    rows += [(200, "s", "They waited for long and then came to the gantry", "a", "m", 1), (201, "s", "They waited for long and then came to the quay", "a", "m", 1)]
    found = {r.doc_id: r.cut for r in find_truncated(spark.createDataFrame(rows, DDL)).where("cut is not null").collect()}
    assert found == {200: "sentence", 201: "word"}
