"""Leak search: planted passages with edits and disguises, against whole-document verification."""

import random
from collections import Counter, defaultdict

import numpy as np

from gridloom.llm.leakage import ItemIndex, Search, WordHashes, find_leaks, is_case, leaked, own_words, shared_sentences, words_in_passages
from gridloom.llm.words import words

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 8))) for _ in range(600)]


def sentence(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def items(n=40):
    rng = random.Random(1)
    return [(i, f"Solve the problem step by step.\n{sentence(rng, rng.randint(14, 25))}. {sentence(rng, rng.randint(14, 25))}. What is the total?") for i in range(n)]


def disguised(rng, ws, kind):
    if kind == "plain":
        return " ".join(ws)
    if kind == "edits":  # at most one word in six
        out = list(ws)
        for k in range(rng.randint(2, 5), len(out), 7):
            out[k] = rng.choice(("", "zzzz", out[k] + " extra"))
        return " ".join(w for w in out if w)
    if kind == "markup":
        return "<p>" + " ".join(f"<b>{w}</b>" if i % 9 == 4 else w for i, w in enumerate(ws)) + "</p>"
    if kind == "quote":
        return "\n".join("> " + " ".join(ws[i : i + 6]) for i in range(0, len(ws), 6))
    if kind == "letters":
        return " ".join(ws).upper().replace("A", "А").replace("E", "\u0435").replace(" ", "\u00a0, ")
    if kind == "entities":
        return "&quot;" + "&nbsp;".join(ws).replace("o", "&#111;") + "&quot;"
    raise ValueError(kind)


KINDS = ("plain", "edits", "markup", "quote", "letters", "entities")


def corpus():
    rng = random.Random(2)
    own = own_words(items(), shared_sentences(t for _, t in items()))
    docs, truth = [], set()
    for d in range(600):
        before, after = sentence(rng, rng.randint(0, 60)), sentence(rng, rng.randint(0, 60))
        i = rng.randrange(40)
        ws = own[i]
        if d % 3 == 0:
            n = max(14, int(len(ws) * rng.uniform(0.5, 1)))
            a = rng.randint(0, len(ws) - n)
            docs.append((d, f"{before} {disguised(rng, ws[a : a + n], KINDS[d // 3 % 6])} {after}"))
            truth.add((d, i))
        elif d % 3 == 1:  # a short phrase only
            a = rng.randint(0, len(ws) - 7)
            docs.append((d, f"{before} {' '.join(ws[a : a + 7])} {after}"))
        else:  # two passages with other words between
            m = len(ws) // 2
            docs.append((d, f"{before} {' '.join(ws[: m - 2])}. {sentence(rng, 20)}. {' '.join(ws[m + 2 :])} {after}"))
            truth.add((d, i))
    return docs, truth, own


def test_planted_passages_are_found():
    docs, truth, own = corpus()
    found = set(leaked(docs, ItemIndex.of(own, Search()), WordHashes()))
    assert len(truth & found) >= 0.99 * len(truth)
    assert not found - truth


def test_recall_against_brute_force():
    docs, _, own = corpus()
    index = defaultdict(set)
    for i, ws in own.items():
        for k in range(len(ws) - 3):
            index[tuple(ws[k : k + 4])].add(i)
    brute = set()
    for d, t in docs:
        ws = words(t)
        for i in {i for k in range(len(ws) - 3) for i in index.get(tuple(ws[k : k + 4]), ())}:
            if is_case(own[i], ws, Search()):
                brute.add((d, i))
    found = set(leaked(docs, ItemIndex.of(own, Search()), WordHashes(most=50)))
    assert len(brute & found) >= 0.99 * len(brute) > 300 and found <= brute


def test_shared_lines_are_not_own():
    texts = [t for _, t in items()]
    assert shared_sentences(texts) == {"solve the problem step by step", "what is the total"}
    assert all("solve" not in ws for ws in own_words(items(), shared_sentences(texts)).values())


def test_find_leaks(spark):
    docs, truth, _ = corpus()
    hot = docs[0]
    rows = [*docs, (9001, None), (9002, ""), (9003, "x " * 50_000 + docs[3][1]), *[(10_000 + i, hot[1]) for i in range(300)]]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int").repartition(4)
    it = spark.createDataFrame([*items(), (77, None), (78, "too short"), (None, "a b c")], "item_id bigint, item_text string")
    item_of = dict(truth)
    want = Counter((*k,) for k in truth) + Counter({(9003, item_of[3]): 1}) + Counter((10_000 + i, item_of[0]) for i in range(300))
    one = Counter((r.doc_id, r.item_id) for r in find_leaks(d, it).collect())
    assert one == want
    assert Counter((r.doc_id, r.item_id) for r in find_leaks(d, it, block=7).collect()) == want
    assert find_leaks(d.limit(0), it).count() == 0 and find_leaks(d, it.limit(0)).count() == 0


def test_words():
    assert words("<p>Caf&eacute; [b]the[/b] thе\u00a0ﬁne</p>\n> so\u00adft") == ["cafe", "the", "the", "fine", "soft"]
    assert words(None) == [] and words("?!") == []


def test_short_second_passage_far_off():
    rng = random.Random(9)
    own = {i: [f"own{i}x{k}" for k in range(30)] for i in range(20)}
    far = lambda n: sentence(rng, n).split()
    docs = [(i, " ".join(far(20) + ws[:8] + far(400) + ws[20:25] + far(20))) for i, ws in own.items()]
    docs += [(100 + i, " ".join(far(20) + ws[:8] + far(400) + ws[20:23] + far(20))) for i, ws in own.items()]  # 11 words: no case
    assert set(leaked(docs, ItemIndex.of(own, Search()), WordHashes())) == {(i, i) for i in own}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_passages(item, text, search):
    """Every range of the item against every range of the text."""
    found = [
        (a, b, s, e)
        for a in range(len(item)) for b in range(a + search.passage_words, len(item) + 1)
        for s in range(len(text)) for e in range(s + 1, len(text) + 1)
        if item[a] == text[s] and item[b - 1] == text[e - 1] and search.words_per_edit * edit_distance(item[a:b], text[s:e]) <= b - a
    ]
    one = max((b - a for a, b, _, _ in found), default=0)
    return max([one] + [b - a + d - c for a, b, s, e in found for c, d, t, _ in found if c >= b and t >= e])


def test_verification_is_exact():
    rng = random.Random(11)
    search = Search(passage_words=3, words_per_edit=3)
    for trial in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(6, 10))]
        text = [rng.choice("abcdefxy") for _ in range(rng.randint(3, 6))]
        for _ in range(rng.randint(0, 2)):  # parts of the item with an edit
            a = rng.randint(0, len(item) - 3)
            part = item[a : a + rng.randint(3, 6)]
            part[rng.randrange(len(part)) : 1] = rng.choice(([], ["x"]))
            at = rng.randint(0, len(text))
            text[at:at] = part
        text = text[:13]
        want = best_passages(item, text, search)
        codes = [np.array([ord(c) for c in ws], np.uint64) for ws in (item, text)]
        for enough in range(3, len(item) + 1):
            assert (words_in_passages(*codes, search, enough) >= enough) == (want >= enough), (item, text, enough, want)


def test_long_tags_are_no_words():
    assert words(f'one <a href="{"x " * 900}">two</a> [url={"y " * 900}]three[/url]') == ["one", "two", "three"]
