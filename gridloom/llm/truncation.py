"""Texts cut off by field limits or broken transfers.

1. Hidden limits: every text's length is recomputed in several units (characters, UTF-8 bytes,
   UTF-16 units) and under escapings it may have had when it was stored (entities, JSON, newline
   conversion). Counted per source, a field limit shows as a pile of different texts at one length,
   tallest in the unit the limit is meant in.
2. Ways to end: over all texts, which lines end posts again and again (closing words), which words may
   end a sentence, and what shape links have. What stands above a signature, and every word and link
   that does not end its text, was not cut, whatever the length of the corpus.
3. Each ending is inspected: inside a character, entity, tag, link or word, or a line that neither
   ends like a sentence nor is a closing, signature, link or quote. At a limit, only a finished
   sentence or sign-off counts as complete.

The texts are read once, whole. That pass leaves a few numbers and keys per text and the counts of
words and links; limits, ways to end and the verdicts follow from these by joins, whose tables may
grow with the corpus.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import cut_lineage

# -- 1: limits -----------------------------------------------------------------------------------

#: Values a cut may fall short of the limit: a character that no longer fits, a trimmed blank.
SLACK = {"utf8": 3, "html_utf8": 3, "json_utf8": 3, "crlf_utf8": 3}


def _count(text: Column, *parts: str) -> Column:
    """How many of the given single ASCII characters the text holds."""
    each = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(p), F.lit(""))) for p in parts]
    return sum(each[1:], each[0])


def character_counts(text: Column) -> dict[str, Column]:
    """What the measures are sums of. The two costly counts run only over texts that need them."""
    chars, utf8, returns = F.length(text), F.octet_length(text), _count(text, "\r")
    without = lambda pattern, by="": F.length(F.regexp_replace(text, pattern, by))
    zero = F.lit(0)
    return {
        "c_chars": chars,
        "c_utf8": utf8,
        "c_amp": _count(text, "&"),
        "c_angle": _count(text, "<", ">"),
        "c_quote": _count(text, '"'),
        "c_apos": _count(text, "'"),
        "c_newline": _count(text, "\n"),
        "c_control": _count(text, "\\", "\t") + returns,
        "c_crlf": F.when(returns == 0, zero).otherwise(chars - without("\r\n", "\n")),
        "c_wide": F.when(utf8 == chars, zero).otherwise(chars - without("[^\\x00-\\x7F]")),
        "c_astral": F.when(utf8 == chars, zero).otherwise(chars - without("[\\x{10000}-\\x{10FFFF}]")),
    }


def measures_of(c: dict[str, Column]) -> dict[str, Column]:
    entities = 4 * c["c_amp"] + 3 * c["c_angle"] + 5 * c["c_quote"]
    bare_newlines = c["c_newline"] - c["c_crlf"]
    json = c["c_quote"] + c["c_newline"] + c["c_control"]
    chars, utf8 = c["c_chars"], c["c_utf8"]
    return {
        "chars": chars,
        "utf8": utf8,
        "utf16": chars + c["c_astral"],
        "html": chars + entities,
        "html_apos": chars + entities + 4 * c["c_apos"],
        "html_utf8": utf8 + entities,
        "json": chars + json,
        "json_ascii": chars + json + 5 * c["c_wide"] + 6 * c["c_astral"],
        "json_utf8": utf8 + json,
        "crlf": chars + bare_newlines,
        "crlf_utf8": utf8 + bare_newlines,
        "lf": chars - c["c_crlf"],
    }


def length_measures(text: Column) -> dict[str, Column]:
    return measures_of(character_counts(text))


def length_limits(docs: DataFrame, text: str, source: str, least: int = 8, times: float = 10.0, shortest: int = 64) -> DataFrame:
    """source, measure, value, n, excess: lengths at which different texts pile up (see :func:`piles_of`)."""
    counted = docs.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.xxhash64(text).alias("digest"), *(c.alias(k) for k, c in character_counts(F.col(text)).items()))
    return piles_of(cut_lineage(counted), least, times, shortest)


def piles_of(counted: DataFrame, least: int = 8, times: float = 10.0, shortest: int = 64) -> DataFrame:
    """source, measure, value, n, excess from source, digest and the character counts of each text.

    Copies of a text count once. A pile has at least ``least`` texts and ``times`` as many as lengths
    nearby have on average (plus one). Below ``shortest`` a pile is one short answer given by many.
    Under other measures a part of the same texts piles up too: each text is left to the tallest pile
    it belongs to, and a pile is kept if it still is one by the texts left to it. So a source may have
    limits in several measures.
    """
    counted = counted.dropDuplicates(["source", "digest"])
    measures = measures_of({k: F.col(k) for k in counted.columns})
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(i).alias("rank"), c.cast("int").alias("value"), F.lit(SLACK.get(m, 1)).alias("slack")) for i, (m, c) in enumerate(measures.items()))))
    lengths = counted.select("source", "digest", each.alias("m")).select("source", "digest", "m.*")
    counts = lengths.groupBy("source", "measure", "rank", "slack", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "measure").orderBy("value")
    near, wide = (F.coalesce(F.sum("n").over(w.rangeBetween(-k, k)), F.lit(0)) for k in (4, 30))
    around = (wide - near) / 52.0
    tall = (F.col("n") >= least) & (F.col("n") > times * (F.col("around") + 1))
    piles = cut_lineage(counts.withColumn("around", around).where((F.col("value") >= shortest) & tall))
    reach = piles.select(F.col("source").alias("__source"), F.col("measure").alias("__measure"), F.col("n").alias("height"), "around", F.col("value").alias("pile"), F.explode(F.sequence(F.col("value") - F.col("slack"), "value")).alias("__value"))
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("measure") == F.col("__measure")) & (F.col("value") == F.col("__value"))
    own = F.max(F.struct("height", (-F.col("rank")).alias("rank"), (F.col("value") == F.col("pile")).alias("full"), "pile", "measure", "around")).alias("p")
    left = lengths.join(reach, on).groupBy("source", "digest").agg(own).where("p.full")
    left = left.groupBy("source", "p.measure", F.col("p.pile").alias("value"), "p.around").agg(F.count("*").alias("n")).where(tall)
    return left.select("source", "measure", "value", "n", (F.col("n") - F.col("around")).alias("excess"))


def with_at_limit(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``at_limit``: the text has the length of one of its source's limits; without a source, of any limit."""
    names = list(measures_of({k: F.lit(0) for k in character_counts(F.lit(""))}))
    slack = F.create_map(*(x for m in names for x in (F.lit(m), F.lit(SLACK.get(m, 1)))))
    reached = limits.select("source", "measure", F.explode(F.sequence(F.col("value") - slack[F.col("measure")], "value")).alias("v"))
    at = F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("measure")).cast("int").alias("i"), F.col("v"))
    reached = reached.select("source", at.alias("at"))
    known = reached.where("source is not null").groupBy(F.col("source").alias("__source")).agg(F.collect_set("at").alias("__at"))
    every = reached.groupBy(F.lit(None).cast("string").alias("__source")).agg(F.collect_set("at").alias("__at"))
    lengths = F.array(*(c.cast("int") for c in measures_of({k: F.col(k) for k in character_counts(F.lit(""))}).values()))
    joined = counted.join(known.unionByName(every), F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("__lengths", lengths)
    return joined.withColumn("at_limit", F.coalesce(F.exists("__at", lambda a: F.get("__lengths", a["i"] - 1) == a["v"]), F.lit(False))).drop("__source", "__at", "__lengths")


# -- 2: ways to end ------------------------------------------------------------------------------

_TOKEN = re.compile(r"([^\W_]+)[^\w]*")
_WORDS = re.compile(r"([^\W_]+)([.!?]?)")
_BREAK = re.compile(r"<br\s*/?>|</?(?:p|blockquote|div|li|ul)(?:\s[^<>]*)?>|\r?\n|\[/?quote[^\[\]]*\]", re.I)
_CLOSER = re.compile(r"</?(?:p|br|blockquote|div|li|ul|b|i|em|strong)\s*/?>|\[/(?:quote|b|i|u|url|code|list)\]", re.I)
_INLINE = re.compile(r"</?(?:b|i|em|strong|u)>|\[/?[biu]\]|\*\*|__|`", re.I)
_LINK = re.compile(r"\b(?:https?|ftp)://\S*", re.I)
_DIGITS = re.compile(r"\d+")
_DELIMITER = re.compile(r"^(?:--|—|_{3,}|={3,}|\*{3,})")
_TERMINATED = re.compile(r"[.!?。！？][\"'”’»)\]*_~]*$")
_SMILEY = re.compile(r"(?:[:;=8][-o^']?[)(\]\[dDpP/|*]|<3|\^\^|\)|~)$")
_DOTS = re.compile(r"\.\.\.$")
_MARK = re.compile(r"(?:…|\[(?:…|\.\.\.|more|truncated|cut)\]|\((?:more|truncated|continued)\))$", re.I)
# a tag with whole attributes and perhaps a part of one more, of any length
_BROKEN_TAG = re.compile(r"<(?:/|/?[a-zA-Z][\w:-]*(?:\s+[\w:-]+=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))*(?:\s+[\w:-]*(?:=(?:\"[^\"<>]*|'[^'<>]*)?)?)?\s*/?)?|\[(?:/|/?[a-zA-Z]{1,10}(?:=[^\[\]\n]*)?)?")
_BROKEN_ENTITY = re.compile(r"&(?:#?[a-zA-Z0-9]{0,31})$")
_UNSTOPPED = re.compile(r"^\s*(?:>|(?:EDIT|UPDATE|NACHTRAG|EDITADO|PS|P\.S\.|NB)\b)")
#: Lines of a signature with its delimiter, and lines looked at above it.
SIGNATURE, ABOVE = 4, 2
#: Words of a post that is one short answer.
ANSWER = 4


def trimmed(text: str) -> str:
    """The text without white space and closing tags at its end."""
    while True:
        text = text.rstrip()
        at = max(text.rfind("<"), text.rfind("[")) if text[-1:] in (">", "]") else -1
        if at < 0 or not _CLOSER.fullmatch(text, at):
            return text
        text = text[:at]


def _lines(text: str) -> list[str]:
    """The last lines that hold anything, in order: those of a signature and above."""
    return [x for x in (y.strip() for y in _BREAK.split(text)) if x][-SIGNATURE - ABOVE :]


def _line_key(line: str) -> str:
    """A line without inline markup, entities, case and the values of numbers."""
    if "&" in line:
        line = html.unescape(line)
    return _DIGITS.sub("#", _INLINE.sub("", line).lower())


def _hash(what: str) -> int:
    return int.from_bytes(hashlib.blake2b(what.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _name(line: str) -> str:
    """A line as the key it is counted by: short and of bounded length, without a line break."""
    return hashlib.blake2b(_line_key(line).encode("utf-8", "replace"), digest_size=15).hexdigest()


def _standing_before(lines: list[str]) -> int:
    """Hash of what the last line closes: the line before it and before a signature; one and the same for none."""
    above = lines[:-1]
    end = max((i for i, x in enumerate(above) if _DELIMITER.match(x)), default=len(above))
    return _hash(_line_key(above[end - 1]) if end else "")


def _signed(lines: list[str]) -> tuple[str | None, int | None]:
    """The line above a signature, which ends the post and was not cut, and a hash of the line before it."""
    end = max((i for i, x in enumerate(lines) if _DELIMITER.match(x)), default=0)
    if not end or _TERMINATED.search(lines[end - 1]):
        return None, None
    return _name(lines[end - 1]), _hash(_line_key(lines[end - 2]) if end > 1 else "")


def _link_shape(link: str) -> str:
    """Letters become ``a``, numbers ``9``: links of one site look alike, cut ones do not."""
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+(?:[-_][^\W\d_]+)*", "a", link.rstrip(".,;:!?)")))


def _asked(word: str) -> str:
    """The word as it is looked up; numbers are whole and need no look: ''."""
    return "" if word.isdigit() else word.lower()


def ending(text: str | None, author: str | None) -> tuple[str, str | None, str | None, list[str]]:
    """(rule, what to look up: a line ``l...`` or link ``k...``, word to look up, the last lines).

    Rules: ``ok`` complete; ``cut ...`` where; the others are decided by :func:`verdict`.
    """
    if text is None or not text.strip():
        return "ok", None, None, []
    bare = text.rstrip()
    last = _lines(trimmed(bare))
    if bare.endswith("�"):
        return "cut character", None, None, last
    if _BROKEN_ENTITY.search(bare, max(0, len(bare) - 34)):  # an entity and its mark
        return "cut entity", None, None, last
    at = max(bare.rfind("<"), bare.rfind("["))
    if at >= 0 and _BROKEN_TAG.fullmatch(bare, at):
        return "cut tag", None, None, last
    if not last:
        return "ok", None, None, last
    line, recent = last[-1], last[-SIGNATURE:]
    stopped = bool(_TERMINATED.search(line))
    link = list(_LINK.finditer(line))
    if link and link[-1].end() == len(line):
        return "link." if stopped else "link", "k" + _link_shape(link[-1][0]), None, last
    if _MARK.search(line):
        return "cut mark", None, None, last
    if m := _DOTS.search(line):  # authors end with dots too, after a whole word
        words = _TOKEN.findall(line[: m.start()])
        return "dots", None, _asked(words[-1]) if words and line[: m.start()][-1:].isalnum() else "", last
    if stopped or (line.startswith("[") and line.endswith("]")) or _SMILEY.search(line):
        return "ok", None, None, last
    if line.startswith("~ "):
        return ("ok" if line.endswith(" ~") else "signature"), "l" + _name(line), None, last
    words = _TOKEN.findall(line)
    asked = "l" + _name(line), _asked(words[-1]) if words else None, last
    name = re.sub(r"\W|_", "", author or "").lower()
    if any(_DELIMITER.match(x) for x in recent):
        own = re.sub(r"\W|_", "", line).lower()
        if own and own == name:
            return "ok", None, None, last
        if not own or (name and len(own) > 2 and name.startswith(own)):
            return "signature", *asked
        # a name that is not the author's: nothing shows it was cut
        return "name" if len(words) == 1 or re.fullmatch(r"[\w-]+\d", line) else "slogan", *asked
    if not words or not line[-1].isalnum():
        return "sentence", *asked
    if len(last) == 1 and len(words) <= ANSWER and not text[: text.find(line)].strip():
        return "answer", *asked
    if _UNSTOPPED.match(line) or any(_UNSTOPPED.match(x) and not x.lstrip().startswith(">") for x in recent[-2:]):
        return "open", *asked
    return "line", *asked


def verdict(rule: Column, at_limit: Column, known: Column, whole: Column, midway: Column) -> Column:
    """Where the text was cut, or null. ``known``: the line or link looked up is one that texts end with.

    ``whole``: the last word may end a sentence; ``midway``: it is a common one that does not.
    """
    none = F.lit(None).cast("string")
    at = lambda kind, other: F.when(at_limit, kind).otherwise(other)
    line = (
        F.when(rule.isin("signature", "sentence"), rule)
        .when(rule == "name", at("signature", none))
        .when(rule == "slogan", F.when(at_limit | ~whole, "signature"))
        .when(rule == "answer", at("sentence", F.when(midway, "word")))
        .when(rule == "open", at("sentence", F.when(~whole, "word")))
        .otherwise(F.when(at_limit | whole, "sentence").otherwise("word"))
    )
    return (
        F.when(rule == "ok", none)
        .when(rule.startswith("cut "), F.substring(rule, 5, 20))
        .when(rule.isin("link", "link."), F.when(~known | (at_limit & (rule == "link")), "link"))
        .when(rule == "dots", F.when(at_limit | ~whole, "mark"))
        .when(~known, line)
    )


_PLAIN = ("rule", "asked", "word", "body")
_NUMBERS = ("context", "body_context", "n", "n_final")


def _read(counts: list[str], held: int = 500_000):
    """Per text a row ``d``: key, source, digest, character counts, and its ending; counts of words ``w`` and links ``k``.

    The text may have been cut in its last word and in a link that ends it, so these are not counted.
    """
    names = ["what", "__key", "source", "digest", *counts, *_PLAIN, *_NUMBERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        final: Counter[str] = Counter()
        links: Counter[str] = Counter()
        key_type = pa.null()

        def ship() -> pa.RecordBatch:
            rows = [("w", x, n, final[x]) for x, n in words.items()] + [("k", x, n, 0) for x, n in links.items()]
            what, word, n, n_final = zip(*rows) if rows else [()] * 4
            size = len(rows)
            given = {"what": pa.array(what, pa.string()), "word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64()), "n_final": pa.array(n_final, pa.int64()), "__key": pa.nulls(size, key_type)}
            types = dict.fromkeys((*_PLAIN, "source"), pa.string())
            words.clear(), final.clear(), links.clear()
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(size, types.get(c, pa.int64())) for c in names], names=names)

        for b in batches:
            key_type = b.column(0).type
            rows = []
            for text, author in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                rule, asked, word, last = ending(text, author)
                body, body_context = _signed(last)
                context = _hash(author or "") if rule == "answer" else _standing_before(last) if asked else None
                rows.append((rule, asked, word, body, context, body_context, 1, None))
                if text:
                    ws = _WORDS.findall(text.lower())[:-1]
                    words.update([w for w, _ in ws])
                    final.update([w for w, stop in ws if stop])
                    links.update("k" + _link_shape(x[0].split("<")[0]) for x in _LINK.finditer(text) if x.end() < len(text.rstrip()))
            columns = [pa.array(c, pa.string() if i < len(_PLAIN) else pa.int64()) for i, c in enumerate(zip(*rows))] if rows else [pa.nulls(0, pa.string())] * 4 + [pa.nulls(0, pa.int64())] * 4
            what = pa.array(["d"] * len(rows), pa.string())
            yield pa.RecordBatch.from_arrays([what, b.column(0), b.column(1), *b.columns[4:], *columns], names=names)
            if len(words) > held:
                yield ship()
        if words or links:
            yield ship()

    return run


#: Share of a word's uses that must end a sentence, or of the ends of a line with it, for it to be a way to end.
RATE = 0.004
#: Below this number a word is rare: its last letters count too.
FREQUENT = 40


def usual_suffixes(words: DataFrame) -> list[str]:
    """Last three letters shared by over 1 / 500 of the rare words; so at most 500."""
    rare = words.where((F.col("n") < FREQUENT) & F.col("word").rlike("^[^\\W\\d]{5,}$"))
    suffixes = rare.groupBy(F.substring("word", -3, 3).alias("key")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # as many rows as there are endings of three letters
    return [r.key for r in suffixes.withColumn("total", total).where("n > 0.002 * total").select("key").collect()]


def closing_lines(ends: DataFrame, words: DataFrame, texts: int, signed: int = 2, least: int = 4) -> DataFrame:
    """asked: lines that end posts again and again (columns of the rows ``d`` with at_limit).

    A line counts once per different line before it, so copies of a post can't pass its cut-off end for
    a closing. It is one if it stands above ``signed`` signatures; or if ``least`` authors gave it as
    their whole answer, of few words; or if it ends ``least`` posts and
    its last word, where it is used elsewhere, ends there at the rate at which words end sentences. A
    word never used elsewhere may be a fragment: then the line must end one post in 5,000.
    """
    last = ends.where("asked like 'l%' and not at_limit").select("asked", "context", "word", F.lit(0).alias("signed"), (F.col("rule") == "answer").cast("int").alias("answer"))
    above = ends.where("body is not null").select(F.concat(F.lit("l"), "body").alias("asked"), F.col("body_context").alias("context"), F.lit(None).cast("string").alias("word"), F.lit(1).alias("signed"), F.lit(0).alias("answer"))
    once = last.unionByName(above).groupBy("asked", "context").agg(*(F.max(c).alias(c) for c in ("signed", "answer", "word")))
    lines = once.groupBy("asked").agg(F.count("*").alias("n_ends"), F.sum("signed").alias("n_signed"), F.sum("answer").alias("n_answers"), F.max("word").alias("word"))
    sure = (F.col("n_signed") >= signed) | (F.col("n_answers") >= least)
    lines = lines.where(sure | (F.col("n_ends") >= least))
    used = words.select(F.col("word").alias("__word"), F.col("n").alias("__n"))
    elsewhere = F.coalesce("__n", F.lit(0))
    often = (F.col("n_ends") >= least) & (F.col("n_ends") > RATE * elsewhere) & ((elsewhere > 0) | (5000 * F.col("n_ends") >= texts))
    return lines.join(used, F.col("word") == F.col("__word"), "left").where(sure | often).select("asked")


def find_truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", author: str = "author") -> DataFrame:
    """``key``, ``source`` and ``cut``: null for a complete text, else where it was cut.

    One row per row of ``docs``, repeated ones included. Null and blank texts are complete: nothing
    shows a cut. A null source is a source of its own and knows the limits of all others; a null
    author matches no signature. Only the usual last letters of words (at most 500) and a few totals
    reach the driver.
    """
    counts = character_counts(F.col("text"))
    slim = docs.select(F.col(key).alias("__key"), F.col(source).alias("source"), F.col(text).alias("text"), F.col(author).alias("author"))
    given = slim.select("__key", "source", "text", "author", F.xxhash64("text").alias("digest"), *(c.cast("bigint").alias(k) for k, c in counts.items()))
    schema = T.StructType(
        [T.StructField("what", T.StringType()), T.StructField("__key", docs.schema[key].dataType), T.StructField("source", T.StringType()), T.StructField("digest", T.LongType())]
        + [T.StructField(k, T.LongType()) for k in counts] + [T.StructField(k, T.StringType()) for k in _PLAIN] + [T.StructField(k, T.LongType()) for k in _NUMBERS]
    )
    read = cut_lineage(given.mapInArrow(_read(list(counts)), schema))
    totals = {r.what: r.n for r in read.groupBy("what").agg(F.sum("n").alias("n")).collect()}  # 3 rows
    words = read.where("what = 'w'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))
    shapes = read.where("what = 'k'").groupBy(F.col("word").alias("asked")).agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, totals.get("k", 0) / 500)).select("asked")
    ends = read.where("what = 'd'").drop("what", "n", "n_final")
    ends = with_at_limit(ends, cut_lineage(piles_of(ends.where("c_chars is not null"))))  # a row per limit
    sure = F.col("rule").isin("ok") | F.col("rule").startswith("cut ")
    asks = ends.where(~sure)
    facts = closing_lines(ends, words, totals.get("d", 0)).unionByName(shapes).select(F.col("asked").alias("__asked"), F.lit(True).alias("__known"))
    # keys that are not asked for stand alone, so that they load no task
    alone = F.concat(F.lit("\n"), F.xxhash64("digest", "__key").cast("string"))
    asks = asks.withColumn("__a", F.coalesce("asked", alone)).withColumn("__w", F.coalesce("word", alone))
    used = words.select(F.col("word").alias("__word"), F.col("n").alias("__n"), F.col("n_final").alias("__final"))
    asks = asks.join(facts, F.col("__a") == F.col("__asked"), "left").join(used, F.col("__w") == F.col("__word"), "left")
    rare = F.coalesce(F.col("__n") < FREQUENT, F.lit(True)) & F.substring("__w", -3, 3).isin(usual_suffixes(words))
    whole = (F.col("__w") == "") | F.coalesce(F.col("__final") > RATE * F.col("__n"), F.lit(False)) | rare
    known = F.coalesce("__known", F.lit(False))
    if not shapes.head(1):  # nothing is known of links
        known = known | F.col("rule").isin("link", "link.")
    decided = asks.select("__key", "source", verdict(F.col("rule"), F.col("at_limit"), known, whole, ~whole & (F.col("__n") >= FREQUENT)).alias("cut"))
    plain = ends.where(sure).select("__key", "source", verdict(F.col("rule"), *[F.lit(False)] * 4).alias("cut"))
    out = decided.unionByName(plain)
    return out.select(F.col("__key").alias(key), F.col("source").alias(source), "cut")


def truncation_by_source(found: DataFrame, source: str = "source") -> DataFrame:
    """Per source: texts, truncated ones and their share."""
    return found.groupBy(source).agg(
        F.count("*").alias("n_docs"), F.count("cut").alias("n_cut"), (F.count("cut") / F.count("*")).alias("share")
    )
