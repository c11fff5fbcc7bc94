import hashlib
import math
import random
import re

import helpers
import pytest
from tokenloom.llm import pii


def plain(text):
    """The detectors as their patterns say, without any short cut."""
    luhn = lambda d: sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, rx, ok in tests for m in re.finditer(rx, text) if ok(m.group())]


def test_detectors_equal_their_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b@", "@", ".", "1", "2", "4", "00", "7", "+", "-", " ", "(", "é", "x.y", "4532015112830366", "1.2.3.4"]) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@") == []
    assert pii.base_spans("1" * 300_000) == []
    assert len(pii.base_spans("1." * 100_000)) == 25_000


def test_mask():
    text = "mail ann@x.org or call"
    assert pii.mask(text, pii.base_spans(text), [("remove", 18, 22)]) == "mail [EMAIL] or [REMOVED]"
    assert pii.mask("Bob 12", [], [("generalise", 0, 3), ("generalise", 4, 6)]) == "[NAME] [NUMBER-2]"


def corpus():
    revealing = [f"note {k} from Zanzibar office write ann.lee@corp.org about topic {k} please" for k in range(5)]
    noise = [f"plain text {k} about please note office from write topic and nothing else" for k in range(60)]
    other = [f"write once{k}@mail.org about topic" for k in range(5)]
    return revealing + noise + other


def test_terms_that_stand_only_beside_an_entity_are_disclosing(spark):
    texts = corpus()
    got = {r.doc_id: r for r in pii.report(helpers.docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        base = [f"{kind}:{s}:{e}" for kind, s, e in plain(t)]
        assert got[k].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        added = got[k].spans.split(",")[len(base) :] if got[k].spans else []
        words = {t[int(x.split(":")[1]) : int(x.split(":")[2])] for x in added}
        assert words == ({"Zanzibar"} if k < 5 else set())
    cleaned = {r.doc_id: r.text for r in pii.sanitise(helpers.docs(spark, texts)).collect()}
    assert cleaned[0] == "note 0 from [REMOVED] office write [EMAIL] about topic 0 please" and cleaned[20] == texts[20]


def test_terms_of_rare_entities_and_of_their_parts_are_rated(spark):
    shared = [f"call Quux about topic {k} at user{k}@acme.example please" for k in range(6)]
    twice = [f"the Zanzibar file {k} of +1 (974) 555-3436 please" for k in range(2)]
    noise = [f"plain text {k} call about topic at please the file of nothing else" for k in range(200)]
    got = {r.doc_id: r.text for r in pii.sanitise(helpers.docs(spark, shared + twice + noise)).collect()}
    assert [got[k] for k in range(6)] == [f"call [REMOVED] about topic {k} at [EMAIL] please" for k in range(6)]
    assert [got[6 + k] for k in range(2)] == [f"the [NAME] file {k} of [PHONE] please" for k in range(2)]
    assert [got[8 + k] for k in range(200)] == noise


def test_disclosing_terms_go_however_far_they_stand(spark):
    gap = " ".join(["note"] * 40)
    far = [f"Zanzibar {gap} Zanzibar {k} {gap} ann.lee@corp.org {gap} {gap} zanzibar" for k in range(6)]
    noise = [f"note {k} of nothing" for k in range(80)]
    got = {r.doc_id: r.text for r in pii.sanitise(helpers.docs(spark, far + noise)).collect()}
    assert [got[k] for k in range(6)] == [f"[REMOVED] {gap} [REMOVED] {k} {gap} [EMAIL] {gap} {gap} [REMOVED]" for k in range(6)]
    assert [got[6 + k] for k in range(80)] == noise


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {r.text for r in out.filter("doc_id = 8").collect()} == {"żółć ▁ 🎉 [EMAIL]"}
    assert out.filter("doc_id = 2").first().text is None and out.filter("doc_id = 5").count() == 2
    rows = pii.report(df)
    assert rows.count() == df.count() and rows.filter("doc_id = 2").first().spans == ""
    assert pii.report(helpers.empty(spark)).count() == 0 and pii.sanitise(helpers.empty(spark)).count() == 0


def plain_disclosure(rows):
    """(text, term) -> disclosure of the terms at GENERALISE or more, from all pairs of the corpus, counted in plain loops."""
    entities, words = {}, {}
    for t in set(rows):
        spans = pii.base_spans(t)
        entities[t] = {n for k, s, e in spans for n in pii.protected(k, t[s:e])}
        masked = list(t)
        for _, s, e in spans:
            masked[s:e] = "\0" * (e - s)
        # a word that a span cuts counts as covered
        words[t] = {m.group().lower() for m in re.finditer(r"\w+", t) if "\0" not in masked[m.start() : m.end()]}
    total, out = len(rows), {}
    for t in set(rows):
        for e in entities[t]:
            n_entity = sum(e in entities[x] for x in rows)
            for w in words[t]:
                n = sum(w in {y.lower() for y in re.findall(r"\w+", x)} for x in rows)
                joint = [x for x in rows if e in entities[x] and w in words[x]]
                pmi, ic = math.log(len(joint) * total / (n_entity * max(n, len(joint)))), math.log(total / n_entity)
                value = pmi / ic * (1 - 0.5 ** len(set(joint))) if ic > 0 else 0.0
                if value >= pii.GENERALISE:
                    out[t, w] = max(out.get((t, w), 0.0), value)
    return out


def test_disclosure_equals_counting_all_pairs(spark):
    rng = random.Random(12)
    people = [f"{n}@{d}.example" for n in ("ann", "bob", "cyd", "dee") for d in ("corp", "shop")] + ["10.1.2.3", "10.1.2.4", "10.9.8.7", "+1 974 555 3436", "+1 974 555 0000"]
    telling = {p: f"tell{k}" for k, p in enumerate(people)}
    rows = []
    for _ in range(130):
        parts = [f"w{rng.randrange(40)}" for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.4:
            p = rng.choice(people)
            parts += [p] + [telling[p]] * (rng.random() < 0.9)
        rng.shuffle(parts)
        rows.append(" ".join(parts))
    rows += rng.choices(rows, k=20) + [f"İzmir w{k} ann@corp.example x" for k in range(5)] + ["w1 İZMİR"]
    expected = plain_disclosure(rows)
    docs = helpers.docs(spark, rows)
    got = {(bytes(r.digest), r.term): r.disclosure for r in pii.disclosing_terms(docs, pii.detect(docs, ("doc_id",))).collect()}
    digest = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
    expected = {(digest(t), w): x for (t, w), x in expected.items()}
    assert len(expected) > 10 and set(got) == set(expected)
    assert all(abs(got[x] - expected[x]) < 1e-9 for x in got)


def test_terms_whose_lower_case_has_other_letters(spark):
    texts = [f"{'İzmir' if k < 5 else 'Zanzibar'} trip number{k} {'ann' if k < 5 else 'bob'}@corp{k // 5}.example" for k in range(10)] + [f"other words here {k}" for k in range(90)]
    out = {r.doc_id: r.text for r in pii.sanitise(helpers.docs(spark, texts)).collect()}
    assert all("İzmir" not in out[k] and "Zanzibar" not in out[k] and "[REMOVED]" in out[k] for k in range(10)), out[0]


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_a_page_of_many_entities(spark, monkeypatch, most):
    """Entities of one text can't reach the threshold with any term, so they make no pairs; many shared ones are split."""
    monkeypatch.setattr(pii, "PAIRS", most)
    made = []
    monkeypatch.setattr(pii, "materialise", lambda df, name, keep=pii.materialise: made.append((name, out := keep(df, name))) or out)
    page = " ".join([f"n{k}@h{k}.example" for k in range(400)] + [f"word{k}" for k in range(3000)])
    shared = [" ".join([f"s{k}@t.example" for k in range(8)] + [f"tell{k}" for k in range(5)] + [f"lone{j}"]) for j in range(3)]
    docs = helpers.docs(spark, [page, *shared, *[f"plain text {k}" for k in range(40)]])
    found = pii.disclosing_terms(docs, pii.detect(docs, ("doc_id",))).collect()
    assert {r.term for r in found} == {f"tell{k}" for k in range(5)} and all(r.rows == 1 for r in found)
    assert dict(made)["pii-pairs"].count() < 10_000
