"""Window dedup, the conversation trie and importance resampling against plain Python, and on odd rows, ties, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from catchment.llm import prefix_trie, resampling, window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
LONG = " ".join(f"x{i}" for i in range(150_000)) + " " + " ".join(f"w{i % 7}" for i in range(300_000))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (None, "null id here " * 9), (6, "é漢😀 ▁ x"), (7, "a" * 400), (8, "same\nline\n" * 20), (4, "same line " * 20), (None, None)]


def windows_by_hand(rows, n):
    holder = {}
    parts = [(-math.inf if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in parts:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            holder[g] = min(holder.get(g, i), i)
    out = []
    for (i, _), (key, w) in zip(rows, parts):
        gone = {k + j for k in range(len(w) - n + 1) if holder[tuple(w[k : k + n])] < key for j in range(n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def passages():
    """Shared passages at word and document borders, a passage in a third of all rows, a document that repeats itself."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(60)}"
    shared = [[word() for _ in range(rng.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            w += shared[0]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            w[rng.randint(0, len(w)) : 0] = s[rng.randint(0, 5) :]
        rows.append((1000 - i * 7 % 113, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(5, " ".join(shared[1] * 3)), (5, " ".join(shared[1]))] + ODD


def sort_key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("n, hot", [(13, False), (13, True), (4, True)])
def test_window_dedup_matches_brute_force(spark, passages, monkeypatch, n, hot):
    if hot:  # every minimiser counts as hot: all windows are dealt one by one, in two meetings
        monkeypatch.setattr(window_dedup, "hot_slots", lambda docs, n, slots: list(range(slots)))
    docs = spark.createDataFrame(passages, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in window_dedup.remove_windows(docs, n).collect()), key=sort_key)
    assert got == sorted((r[:4] for r in windows_by_hand(passages, n)), key=sort_key)


def test_window_texts_and_counts(spark, passages):
    rows = [r for r in passages if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = Counter((r.doc_id, r.text) for r in window_dedup.without_windows(docs).collect())
    assert texts == Counter((r[0], r[4]) for r in windows_by_hand(rows, 13))
    count, first = Counter(), {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            g = " ".join(w[k : k + 13])
            count[g] += 1
            first[g] = min(first.get(g, i), i)
    want = {g: (k, first[g]) for g, k in count.items() if k > 1}
    got = window_dedup.window_counts(docs).collect()
    assert len(got) == len(want) and {r.window: (r.n, r.first_doc_id) for r in got} == want


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With all hashes equal the bytes alone decide."""
    texts = ["a b c d e f", "b c d x", "c d e f g", "q b c d"]
    c = window_dedup.Words(texts)
    at = window_dedup._windows(c, 3)
    row = c.w_doc[at]
    w = window_dedup.Windows(c.flat, c.first, c.last, at, row.astype(np.int64), row, at - c.w_lo[row], np.ones(len(at), np.int64), 3)
    lost, total, _ = window_dedup.judge(w)
    monkeypatch.setattr(window_dedup.Windows, "hashes", lambda self: np.zeros(len(self.at), np.uint64))
    again, same, _ = window_dedup.judge(w)
    assert lost.tolist() == again.tolist() and lost.any() and total.tolist() == same.tolist()


def test_packed_strings_hold_their_windows():
    c = window_dedup.Words(["a b c d e f g", "", "h i j k l"])
    at = window_dedup._windows(c, 3)
    row = c.w_doc[at]
    w = window_dedup.Windows(c.flat, c.first, c.last, at, row.astype(np.int64) * 10, row, at - c.w_lo[row], np.arange(1, len(at) + 1), 3)
    keep = np.array([0, 1, 3, 5, 6, 7])
    packed = window_dedup._pack(w, keep, w.count, np.array([0, 2, 3]), np.array([4, 9, 4]))
    back = window_dedup._unpack(list(packed.values()), 3)
    words = lambda x, i: x.flat.tobytes()[x.start[x.at[i]] : x.end[x.at[i] + 2]]
    show = lambda x, which: sorted((words(x, i), int(x.doc[i]), int(x.place[i]), int(x.count[i])) for i in which)
    assert show(back, range(len(back.at))) == show(w, keep.tolist())


def test_hot_minimisers_are_found(spark):
    """A slot is hot by its share alone; what is hot does not change the result (above)."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)] + [(1000 + i, " ".join(["so"] * 3 * 13 + [f"u{i}"])) for i in range(40)]
    hot = window_dedup.hot_slots(spark.createDataFrame(rows, SCHEMA), 13, 4096)
    c = window_dedup.Words([rows[-1][1]])
    assert int(window_dedup._slot(window_dedup.minimisers(window_dedup.word_hashes(c.flat, c.first, c.last), 13)[:1], 4096)[0]) in hot and len(hot) < 4096 / window_dedup.HOT


def test_very_long_text_in_windows(spark):
    rows = [(1, LONG), (2, LONG[-200:] + " end"), (3, "y " + LONG)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in window_dedup.remove_windows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: r[1:3] for r in windows_by_hand(rows, 13)}


def trie_by_hand(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - int(math.fmod(c, 20))
        built[c] = turns.get(lender, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=sort_key)


CONVS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    say = lambda: (rng.choice(["user", "assistant"]), rng.choice(["yes", "no thanks", "a b c", "", "é 漢"]))
    rows = []
    for c in rng.sample(range(-50, 700), 260):
        rows += [(c, t, *say()) for t in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    rows += [(c, t, "user", "the same") for c in range(1000, 1090) for t in range(6)]  # a third share one path
    rows += [(5000, None, None, None), (5000, 2, "user", None), (5000, 2, "user", None), (5000, 2, "assistant", "tie"), (None, 1, "user", "nobody's")]
    rows += [(5020, t, "user", f"long {t % 2}") for t in range(400)] + [(5021, t, "user", f"long {t % 2}") for t in range(350)]
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_trie_matches_brute_force(spark, talks, parts):
    """One range has no border; in forty ranges most points lie on one."""
    got = prefix_trie.prefix_trie(spark.createDataFrame(talks, CONVS).repartition(7), parts).collect()
    assert sorted((tuple(r) for r in got), key=sort_key) == trie_by_hand(talks)


def test_trie_creates_points_only_where_paths_part():
    """A stack over sorted paths holds ends and branches; a run of single turns is one edge."""
    path = prefix_trie.Path(prefix_trie.Point(0, np.empty(0, np.int32)))
    ones = np.ones(1000, np.int32)
    path.stack.append(prefix_trie.Point(1000, ones, 1, 7, "x"))
    path.rise(600)
    path.stack.append(prefix_trie.Point(900, ones[:300], 1, 3, "y"))
    path.rise(0)
    path.settle(path.floor)
    edges = sorted((e[3][1], e[3][2], e[3][0], e[3][3], e[3][6]) for e in path.done)
    assert edges == [(0, 600, 3, 2, 0), (600, 900, 3, 1, 0), (600, 1000, 7, 1, 0)] and path.floor.saved == 600


def test_trie_of_nothing_and_of_one(spark):
    make = lambda rows: [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVS)).collect()]
    assert make([]) == [] and make([(None, 1, "a", "b")]) == []
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 > 0 and c % 20)  # borrows from nobody, and has no turn beyond
    assert make([(lone, 1, "a", "b")]) == trie_by_hand([(lone, 1, "a", "b")]) and len(make([(lone, 1, "a", "b")])) == 1


def resampled_by_hand(docs, target):
    def features(t):
        w = FEATURE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x[1] for x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(long[: 25 * len(long) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=sort_key)


def test_resampling_matches_brute_force(spark):
    rng = random.Random(8)
    vocab = ["Alpha", "beta", "Ünder", "x" * 50, "y" * 33, "z" * 32, "42", "O'Neil", "naïve", "漢字"] + [f"w{i}" for i in range(200)]
    text = lambda: rng.choice([" ", ", ", "\x00"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))
    docs = [(rng.randrange(10**6), text()) for _ in range(300)] + ODD + [(9, "tie " * 30), (9, "tie " * 30), (10, LONG[:300_000])]
    target = [text() for _ in range(40)] + [None, ""]
    got = resampling.resample(spark.createDataFrame(docs, SCHEMA).repartition(6), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=sort_key) == resampled_by_hand(docs, target)


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(25)), i * 2, 1) for i in range(40)], "doc_id long, text string, rank long, part int")
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    ranks = {r.doc_id for r in resampling.resample(docs, target).filter("rank is not null").collect()}
    kept = resampling.drawn(docs, target)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ranks and len(ranks) == 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert window_dedup.remove_windows(none).collect() == [] and resampling.resample(none, none.select("text")).collect() == []
    assert window_dedup.window_counts(none).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS twin", "3 AS spans", "4 AS slot")
    assert [tuple(r)[:3] for r in window_dedup.remove_windows(one).collect()] == [(1, 2, 0)]
