"""Filter audit, repeated runs and decontamination against brute force, and their edge cases."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from riskloom.llm import decontaminate, filter_audit, queries, repetition

SCHEMA = "doc_id long, text string, source string, part string, mask int, runs int, digest string, words string, items string, spans int, n long"


def odd_rows():
    long = " ".join(f"Word{i % 977} the" for i in range(20_000))
    texts = [None, "", " \n\t ", "one", "one two", "a b " * 30, long, long, long + " end", "SHOUT $5", "Été été été", "x y"]
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", "p", 1, 2, "d", "w", "i", 3, 4) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "one", "", "p", 1, 2, "d", "w", "i", 3, 4), (9, "other text", "s1", "p", 1, 2, "d", "w", "i", 3, 4), (-4, "a b " * 30, "s1", "p", 1, 2, "d", "w", "i", 3, 4)]


# --- filter audit ---


def brute_audit(rows, good, toxic):
    def fails(i, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        return out | ({"E"} if any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows) else set())

    told = [(part or "", fails(i, text), i in good, i in toxic) for i, text, part in rows]
    out = {}
    for part in {p for p, *_ in told}:
        own = [x for x in told if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                here = [x for x in own if not x[1] & earlier]
                removed = [x for x in here if f in x[1]]
                total[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(here) - len(removed), len(removed), sum(f in x[1] for x in own) - len(removed), sum(x[1] == {f} for x in own),
                    sum(x[2] for x in removed), sum(x[3] for x in removed), f,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = total[out[key][-1]]
    return out


def test_audit_equals_counting_every_order(frame):
    rows = odd_rows()
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, None), (5, 0, 1), (9, None, 1), (None, 1, 1), (6, 1, 0), (777, 1, 1)]
    got = filter_audit.audit_filters(frame(rows, SCHEMA), frame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit([r[:3] for r in rows], {1, 3, 6}, {3, 5, 9})
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want
    assert len(got) == 600 * len({k[0] for k in want})


def test_audit_shares_sum_to_what_any_filter_removes(frame):
    rows = [(i, " ".join(random.Random(i).choices("aB$", k=i * 7 % 400)), "s") for i in range(60)]
    got = filter_audit.audit_filters(frame(rows, "doc_id long, text string, source string"), frame([], "doc_id long, quality int, toxic int")).collect()
    shares = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}
    last = {r["filter_order"]: r["kept"] for r in got if r["step"] == 5}
    assert len(set(last.values())) == 1 and sum(shares.values()) == 120 * (60 - last["ABCDE"])


def test_audit_of_an_empty_table_has_no_part(frame):
    got = filter_audit.audit_filters(frame([], SCHEMA), frame([], "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.count() == 0


# --- repeated runs ---


def brute_runs(words):
    count, found = len(words), {}
    for period in range(1, count // 4 + 1):
        i = 0
        while i + period < count:
            j = i
            while j + period < count and words[j] == words[j + period]:
                j += 1
            if j + period - i >= max(6, 4 * period):
                found.setdefault((i, j + period - i), period)
            i = j + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def repetitive(rng):
    letters = rng.choice([1, 2, 3, 9])
    words = [rng.randrange(letters) for _ in range(rng.randrange(70))]
    for _ in range(rng.randrange(3)):
        if words:
            i, size = rng.randrange(len(words)), rng.randrange(1, 9)
            words[i:i] = words[i : i + size] * rng.randrange(1, 9)
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    documents = [repetitive(rng) for _ in range(8)]
    for words, runs in zip(documents, repetition.runs_of([np.array(words, np.int64) for words in documents])):
        by_start = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        assert [tuple(r) for r in runs.tolist()] == by_start


def test_extensions_equal_comparing_word_by_word():
    rng = random.Random(3)
    words = np.array([rng.randrange(2) for _ in range(150)] * 2 + [1] * 40)
    grammar = repetition.Grammar(np.r_[0, words + 2, 1], 2)
    pairs = np.array([(a, b) for a in range(0, len(words), 7) for b in range(3, len(words), 11) if a != b])
    ahead = grammar.extensions(pairs[:, 0] + 1, pairs[:, 1] + 1, forward=True)
    behind = grammar.extensions(pairs[:, 0] + 1, pairs[:, 1] + 1, forward=False)
    for (a, b), f, g in zip(pairs.tolist(), ahead, behind):
        tail = np.flatnonzero(words[a : len(words) - max(0, b - a)][: len(words) - max(a, b)] != words[b:][: len(words) - max(a, b)])
        head = np.flatnonzero(words[:a][::-1][: min(a, b)] != words[:b][::-1][: min(a, b)])
        assert f == (tail[0] if len(tail) else len(words) - max(a, b)) and g == (head[0] if len(head) else min(a, b))


def test_grid_of_long_texts_equals_the_cached_one(monkeypatch):
    words = np.array([random.Random(5).randrange(2) for _ in range(900)])
    short = repetition.candidates(words)
    monkeypatch.setattr(repetition, "_CACHED_WORDS", 100)
    monkeypatch.setattr(repetition, "_CANDIDATES", 500)
    long = repetition.candidates(words)
    assert set(zip(*(x.tolist() for x in short))) == set(zip(*(x.tolist() for x in long)))


def test_a_word_repeated_throughout_a_very_long_text_is_one_run():
    assert repetition.runs_of([np.zeros(300_000, np.int64)])[0].tolist() == [[0, 300_000, 1]]


def test_planted_stretches_follow_their_formula():
    import zlib

    hit = 0
    for doc_id in range(200):
        words = [f"w{i}".encode() for i in range(doc_id % 37)]
        key, count = zlib.crc32(str(doc_id).encode()), len(words)
        want = list(words)
        if key % 10 == 0 and count:
            a = key // 10 % count
            p = 1 + (count - a) // (3 + key // 10 % 8)
            want[a:] = [words[a + (i - a) % p] for i in range(a, count)]
            hit += 1
        assert repetition.planted(doc_id, words) == want
    assert hit and repetition.planted(None, [b"x"]) == [b"x"]


def test_runs_of_odd_rows_and_the_collapsed_text(frame):
    rows = odd_rows()
    got = repetition.find_runs(frame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for row in got:
        texts = [(r[1] or "") for r in rows if r[0] == row["doc_id"]]
        collapsed = bytes(row["collapsed"]).decode()
        assert any(_collapsed(t) == (row["n_words"], [tuple(r) for r in row["runs"]], collapsed) for t in texts)
    assert repetition.find_runs(frame([], SCHEMA)).count() == 0


def _collapsed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2])) if len(words) < 1000 else [(0, 40_000, 2 * 977)]
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    return len(words), runs, " ".join(kept)


def test_registered_runs_query_digests_whole_results(spark, tmp_path):
    texts = ["a b " * 9 + "z " * 7, "", None, "no run here at all", "q " * 6 + "r " * 6]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    for doc_id, text in enumerate(texts, 1):
        words = [w.decode() for w in repetition.planted(doc_id, (text or "").encode().split())]
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        row = got[doc_id]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


# --- decontamination ---

BENCHMARK = "item_id string, text string, doc_id int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_overlap(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        size = min(window, len(own))
        for k in range(max(1, len(own) - window + 1) if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(item or "")
    return len(words), len(hit), sorted(found)


def contaminated(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] + ["Été", "It's"]
    items = [(str(i) if i % 5 else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 5, 9, 30])))) for i in range(12)]
    items += [("dup", items[3][1]), ("dup", "w1 W2-w3"), ("null", None)]
    docs = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.randrange(60))
        if i % 2:
            words[5:5] = (rng.choice(items)[1] or "").split()
        docs.append((i, " ".join(words)))
    return [*docs, (None, docs[1][1]), (1, "w1 W2 w3"), docs[3], (50, None), (51, "")], items


@pytest.mark.parametrize(("seed", "window", "sizes"), [(1, 4, {}), (2, 5, {"shard_words": 50}), (3, 4, {"shard_words": 100, "block_bytes": 400})])
def test_overlaps_equal_brute_force_in_shards_and_blocks(frame, seed, window, sizes):
    docs, items = contaminated(seed)
    table, benchmark = frame(docs, "doc_id long, text string"), frame([(*x, 1) for x in items], BENCHMARK)
    got = decontaminate.find_overlaps(table, benchmark, window=window, **sizes).collect()
    told = sorted((r["doc_id"] or -1, r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got)
    assert told == sorted((i or -1, *brute_overlap(t, items, window)) for i, t in docs)
    kept = decontaminate.clean_documents(table, benchmark, window=window, **sizes).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted((i or -1, t or "") for i, t in docs if not brute_overlap(t, items, window)[2])


def test_overlaps_of_odd_rows_and_empty_tables(frame):
    items = [("x", "one two"), ("y", "word3 the word4 the word5 the word6 the word7 the WORD8"), ("e", "")]
    benchmark = frame([(*x, 1) for x in items], BENCHMARK)
    rows = odd_rows()
    got = decontaminate.find_overlaps(frame(rows, SCHEMA), benchmark).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["items"]) for r in got if r["items"]) == [(4, ["x"]), (6, ["y"]), (7, ["y"]), (8, ["y"])]
    assert decontaminate.find_overlaps(frame([], SCHEMA), benchmark).count() == 0
    assert decontaminate.find_overlaps(frame(rows, SCHEMA), frame([], BENCHMARK)).filter("size(items) > 0").count() == 0
    clean = decontaminate.clean_documents(frame(rows, SCHEMA), benchmark)
    assert clean.columns == frame([], SCHEMA).columns and clean.count() == len(rows) - 4


def test_longest_matches_equal_brute_force(frame):
    docs, items = contaminated(7)
    items = [(f"i{k}", text) for k, (_, text) in enumerate(items)]
    got = decontaminate.longest_matches(frame(docs, "doc_id long, text string"), frame([(*x, 1) for x in items], BENCHMARK), least=3, shard_words=80).collect()
    texts = [(i, words_of(t)) for i, t in docs]
    want = set()
    for item, text in items:
        own = words_of(text)
        for at in range(len(own)):
            places = {}
            for i, words in texts:
                for k in range(len(words)):
                    n = 0
                    while at + n < len(own) and k + n < len(words) and own[at + n] == words[k + n]:
                        n += 1
                    places.setdefault(n, []).append(i)
            best = max(places, default=0)
            if best >= 3:
                want.add((item, at, best, min((i for i in places[best] if i is not None), default=None), len(places[best])))
    assert {tuple(r) for r in got} == want


def test_suffix_arrays_sort_all_suffixes():
    rng = random.Random(2)
    for _ in range(100):
        codes = np.array([rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(60))], np.int64)
        assert decontaminate.suffix_array(codes).tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
