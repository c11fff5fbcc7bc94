import math
import random
import re
from collections import Counter

import helpers
import numpy as np
from tokenloom.llm import decontam


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def items(rng, words, n=60):
    weights = [1 / (k + 1) for k in range(len(words))]
    line = lambda: " ".join(rng.choices(words, weights, k=rng.randint(4, 12))) + "."
    return [(k, " ".join(line() for _ in range(rng.randint(1, 4)))) for k in range(n)]


def shares(rows):
    """For each item with a word: its words, its length and each word's share of its BM25 score, by the formula."""
    bags = {}
    for k, (_, text) in enumerate(rows):
        words = re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (text or "").lower())
        if words:
            bags[k] = words
    n, df = len(bags), Counter(w for b in bags.values() for w in set(b))
    average = sum(map(len, bags.values())) / max(1, n)
    out = {}
    for k, words in bags.items():
        norm = decontam.K1 * (1 - decontam.B + decontam.B * len(words) / average)
        score = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (decontam.K1 + 1) / (tf + norm) for w, tf in Counter(words).items()}
        whole = sum(score.values())
        out[k] = words, {w: x / whole for w, x in score.items()}
    return out


def plain(rows, text):
    """(item number, first word) -> share of every passage and item at the threshold, by scoring everything."""
    words = re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", text.lower())
    out = {}
    for k, (mine, share) in shares(rows).items():
        stride = decontam.class_of(len(mine))
        for p in range(max(1, -(-len(words) // stride) - 1)):
            have = set(words[p * stride : (p + 2) * stride])
            if (x := sum(v for w, v in share.items() if w in have)) >= decontam.THRESHOLD - 1e-9:
                out[k, p * stride] = x
    return out


def plain_leaks(rows, texts):
    """(document, item) of verified leaks: the overlaps of every passage at the threshold, over plain strings."""
    out = {}
    for d, text in enumerate(texts):
        words = re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", text.lower())
        for (k, lo), share in plain(rows, text).items():
            sentences = [x for x in (re.findall(r"\w+", y.lower()) for y in re.split(r"(?<=[.!?])\s+", rows[k][1])) if x]
            whole = [w for x in sentences for w in x]
            cut = len(whole) - len(sentences[-1]) if len(sentences) > 1 else -(-2 * len(whole) // 3)
            question, answer = whole[:cut], whole[cut:] or whole[-1:]
            here = words[lo : lo + 2 * decontam.class_of(len(whole))]
            runs = {tuple(question[i : i + 3]) for i in range(max(1, len(question) - 2))}
            held = sum(any(tuple(here[i : i + len(r)]) == r for i in range(len(here))) for r in runs) / len(runs)
            answered = len(set(answer) & set(here)) / len(set(answer))
            if held >= decontam.QUESTION and answered >= decontam.ANSWER:
                out[d, rows[k][0]] = max(out.get((d, rows[k][0]), 0.0), share)
    return out


def test_retrieval_equals_scoring_everything(monkeypatch):
    monkeypatch.setattr(decontam, "SHORT", 4)
    monkeypatch.setattr(decontam, "BLOCK", 4)
    rng = random.Random(7)
    words = vocabulary(rng)
    rows = items(rng, words)
    indexes = decontam.build(rows)
    assert len(indexes) == 3
    place = {i: k for k, (i, _) in enumerate(rows)}
    for _ in range(60):
        parts = [rng.choice(rows)[1] if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
        text = " ".join(" ".join(p.split()[: rng.randint(1, 40)]) for p in parts)
        raw = decontam.encoded(text)
        data = np.frombuffer(raw, np.uint8)
        starts, ends, first = decontam.word_spans(data, np.array([0, len(data)]), decontam._SEPARATOR)
        keys = decontam.word_keys(data, starts, ends)
        got = {}
        for index in indexes:
            for _, i, lo, _, share in decontam.retrieve(index, keys, first):
                assert (place[index.items[i]], lo) not in got
                got[place[index.items[i]], lo] = share
        expected = plain(rows, text)
        assert set(got) == set(expected) and all(abs(got[x] - expected[x]) < 1e-9 for x in got)


def test_search_equals_adding_up_all_lists(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 3)
    rng = random.Random(9)
    words = vocabulary(rng, 60)
    (index,) = decontam.build(items(rng, words, 150))
    for _ in range(300):
        query = sorted(rng.sample(range(len(index.vocabulary)), rng.randint(0, 30)))
        sums = Counter()
        for t in query:
            for i, x in zip(*index.postings(t)[:2], strict=True):
                sums[i] += x
        assert sorted(i for i, _ in decontam.search(index, query)) == sorted(i for i, x in sums.items() if x >= decontam.THRESHOLD - 1e-9)


def mixed(rng, words, rows, n=60):
    """Texts of filler, whole items, cut items and items with other words between."""
    filler = lambda: " ".join(rng.choices(words, k=rng.randint(0, 120)))
    texts = []
    for k in range(n):
        given = rng.choice(rows)[1] or ""
        if k % 4 == 1:
            given = given[: rng.randint(0, len(given))]
        if k % 4 == 2:
            given = " ".join(w for w in given.split() if rng.random() < 0.8)
        texts.append(f"{filler()} {given} {filler()}" if k % 4 < 3 else filler())
    return texts


def test_matches_equal_plain_overlaps_for_any_size_of_index(spark, monkeypatch):
    rng = random.Random(10)
    words = vocabulary(rng)
    rows = [*items(rng, words, 40), (40, None), (41, ""), (42, "..."), (43, " ".join(rng.choices(words, k=300)) + ". " + " ".join(words[:5])), (44, "one"), (45, "two words")]
    rows += [(46, rows[3][1])]
    texts = mixed(rng, words, rows) + [rows[43][1], "one", "Two, WORDS!"]
    bench, docs = spark.createDataFrame(rows, "item_id long, text string"), helpers.docs(spark, texts)
    found = []
    for size in (500, 32 << 20):
        monkeypatch.setattr(decontam, "INDEX_BYTES", size)
        found.append({(r.doc_id, r.item_id): r for r in decontam.matches(docs, bench).collect()})
        assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in found[-1]}
    expected = plain_leaks(rows, texts)
    assert set(found[0]) == set(found[1]) == set(expected) and len(expected) > 20
    for x, r in found[1].items():
        assert abs(r.score - expected[x]) < 1e-9
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[2:], found[0][x][2:], strict=True))


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(8)
    words = vocabulary(rng)
    rows = items(rng, words)
    filler = lambda: " ".join("zz" + w for w in rng.choices(words, k=rng.randint(0, 300)))
    texts, expected = [], set()
    for k in range(80):
        if k % 4 == 0:
            i, t = rng.choice(rows)
            texts.append(f"{filler()} {t.upper() if k % 8 == 0 else t.replace(' ', chr(10))} {filler()}")
            expected.add((k, i))
        else:
            texts.append(filler())
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(helpers.docs(spark, texts), bench).collect()}
    assert expected <= got and {d for d, _ in got} == {d for d, _ in expected}
    kept = {r.doc_id for r in decontam.clean(helpers.docs(spark, texts), bench).collect()}
    assert kept == set(range(80)) - {d for d, _ in expected}


def test_long_items_need_their_answer(spark):
    question, answer = " ".join(f"u{k}" for k in range(296)) + ".", "the answer has four more words"
    bench = spark.createDataFrame([(1, f"{question} {answer}"), (2, "short one here. yes")], "item_id long, text string")
    docs = helpers.docs(spark, [" ".join(question.split()[:256]), question, f"x {question} {answer} y", "Short one, here! YES", "nothing", answer])
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == {(2, 1), (3, 2)}


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    bench = spark.createDataFrame([(1, helpers.WORDS), (1, helpers.WORDS), (2, None)], "item_id long, text string")
    got = decontam.matches(df, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "5", "5", "None"] and {r.passage_word for r in got} == {0}
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 4
    none = bench.limit(0)
    assert decontam.matches(df, none).count() == 0 and decontam.clean(df, none).count() == df.count() and decontam.matches(helpers.empty(spark), bench).count() == 0
