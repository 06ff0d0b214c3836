import random
import re

import pytest

from lodestone.llm import licenses as L
from lodestone.llm.decontamination import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=10):
    out = []
    grams = {(tuple(w[s : s + window]), i) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - window + 1))}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for gram, item in grams:
            for s in range(len(w) - len(gram) + 1):
                if tuple(w[s : s + len(gram)]) == gram:
                    hit.update(range(s, s + len(gram)))
                    found |= {item} - {None}
        out.append((str(i), len(w), len(hit), sorted(str(x) for x in found)))
    return sorted(out)


@pytest.mark.parametrize("room", [200_000, 0])
def test_contamination_is_that_of_brute_force(spark, odd_rows, room):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (2, passage.upper() + " thirteen"), (3, "short item"), (4, "a a a a a a a a a a a a"), (5, ""), (6, None), (7, "x")]
    texts = [passage, "zero " + passage, passage[4:], " ".join(passage.split()[:9]), "pre " + " ".join(passage.split()[1:11]) + " post", "the Short, item! again short item", "a " * 30, passage + " " + passage, "X y x"]
    rows = [r[:2] for r in odd_rows if len(r[1] or "") < 20_000] + [(100 + i, t) for i, t in enumerate(texts)]
    items += [(i, f"own{i} words{i} " + passage) for i in range(8, 20)] + [(8, items[0][1]), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=room).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in got) == brute(rows, items)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_hit for r in got)


def test_contamination_of_empty_tables(spark, odd_rows, clashing_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(clashing_docs, none).where("n_hit > 0").count() == 0
    assert contamination(clashing_docs, none).count() == len(odd_rows)
    assert contamination(no_docs, none).count() == 0


def test_license_places_are_those_of_brute_force(spark, odd_rows, odd_docs, clashing_docs, no_docs):
    want = []
    for i, t, *_ in odd_rows:
        w = words(t)
        places = [(s, label) for phrase, label in L.PHRASES.items() for p in [phrase.split()] for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
        starts = [s for s, _ in places]
        want.append((str(i), len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    for docs in (odd_docs, clashing_docs):
        got = L.scan_licenses(docs).collect()
        assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
        assert all(0 <= r.score <= 1 and (r.score == 1 if r.n_base else True) for r in got)
    assert L.scan_licenses(no_docs).count() == 0


def brute_notices(w):
    """(begin, end, label, share, verified) of every place of every notice, from the words themselves."""
    out = []
    for label, text in L.NOTICES.items():
        n = text.split()
        diagonals = {}
        for i in range(len(w) - L.NOTICE_K + 1):
            for j in range(len(n) - L.NOTICE_K + 1):
                if w[i : i + L.NOTICE_K] == n[j : j + L.NOTICE_K]:
                    diagonals.setdefault(i - j, []).append((i, j))
        places, reached = [], None
        for d in sorted(diagonals):
            runs = diagonals[d]
            if places and d - places[-1][-1] <= L.DRIFT and min(runs)[0] <= reached + len(n):
                places[-1] = [*places[-1][:-1], *runs, d]
            else:
                places.append([*runs, d])
            reached = max(reached or 0, max(runs)[0] + L.NOTICE_K)
        for *runs, _ in places:
            here = {i + x for i, _ in runs for x in range(L.NOTICE_K)}
            there = {j + x for _, j in runs for x in range(L.NOTICE_K)}
            begin, end = min(here), max(here) + 1
            share = len(there) / len(n)
            fits = end - begin <= 1.5 * len(n) and len(here) / (end - begin) >= L.SHARE
            out.append((begin, end, label, share if fits else share / 2, fits and share >= L.SHARE))
    return out


def test_labels_and_scores_are_those_of_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(250):
        text = []
        for _ in range(r.randint(0, 3)):
            notice = r.choice([*L.NOTICES.values(), *L.PHRASES]).split()
            begin, end = sorted(r.choices(range(len(notice) + 1), k=2)) if r.random() < 0.4 else (0, len(notice))
            part = [w for w in notice[begin:end] if r.random() > r.choice([0, 0.02, 0.1, 0.3])]
            for _ in range(r.choice([0, 0, 1, 3, 10])):
                part.insert(r.randint(0, len(part)), "other")
            text += part * r.choice([1, 1, 1, 2, 3]) + ["filler"] * r.choice([0, 1, 5, 60])
        rows.append((i, " ".join(text)))
    got = {x.doc_id: x for x in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    for i, t in rows:
        w = words(t)
        notices = brute_notices(w)
        phrases = {label for p, label in L.PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()}
        labels = phrases | {label for _, _, label, _, sound in notices if sound}
        assert got[i].labels == ",".join(sorted(labels)), t
        assert abs(got[i].score - max([0.0, *(x[3] for x in notices), *(1.0 for _ in phrases)])) < 1e-9
        spans = {(s.begin, s.end, s.label) for s in got[i].spans if s.kind == "notice"}
        assert spans == {(b, e, label) for b, e, label, _, sound in notices if sound}


def test_runs_that_a_text_repeats_are_no_notice(spark):
    text = "is licensed under the creative commons " * 3
    got = L.scan_licenses(spark.createDataFrame([(1, text), (2, text * 40)], "doc_id long, text string")).collect()
    assert all(r.labels == "" and r.score < L.SHARE for r in got)


def test_notices_are_found_with_words_lost_and_inserted(spark):
    notice = L.NOTICES["bsd"].split()
    broken = [*notice[:6], "inserted", *notice[6:12], *notice[13:]]
    rows = [(1, "x " * 40 + " ".join(broken) + " y" * 40), (2, " ".join(notice[:6])), (3, "of the and or " * 50), (4, " ".join(notice).title())]
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "bsd" and got[1][1] >= L.SHARE and got[2][0] == "" and got[3] == ("", 0.0) and got[4] == ("bsd", 1.0)
