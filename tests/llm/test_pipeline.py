"""The pipeline: each stage and run() against plain Python on a small planted table, and odd rows."""

import random
import re

import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ABUSE = ["zorkish", "blattern", "frimsel", "gruntop"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """(documents, labels, toxic ids): clean texts, toxic ones, near copies, repeated lines, mail addresses, a text of repeated lines alone."""
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "l", "m")]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 20)))
    docs, toxic = [], set()
    for i in range(120):
        lines = [line() for _ in range(rng.randint(2, 5))]
        if i % 6 == 5:
            toxic.add(i)
            lines[0] += " " + " ".join(rng.choice(ABUSE) for _ in range(4))
        if i % 10 == 3:
            lines.append(f"write to user{i % 4}@mail.example.org now")
        docs.append((i, "\n".join(lines)))
    shared = "all rights of this text are kept by those who wrote it down"
    docs += [(200, docs[0][1] + "\n" + shared), (201, docs[7][1].split("\n")[0] + "\nsome words of its own follow here\n" + shared), (202, shared + "\n" + docs[1][1].split("\n")[0])]
    long = [rng.choice(vocab) for _ in range(300)]
    # copies whose lines fall apart elsewhere: the line stage leaves them, the near-duplicate stage does not
    near = [" ".join(w + ("\n" if k % (9 + j) == 8 else "") for k, w in enumerate(long)) for j in (0, 4)]
    docs += [(210, near[0]), (211, near[1]), (220, ""), (221, None)]
    labels = [(i, int(i not in toxic), int(i in toxic)) for i in range(120)]
    return docs, labels, toxic


def saved(spark, folder, docs, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def without_repeats(rows):
    seen, out = [], []
    for i, t in sorted(rows):
        if t is None:
            out.append((i, t))
            continue
        kept, gone = [], 0
        for x in t.split("\n"):
            s = frozenset(WORD.findall(x))
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone += 1
            else:
                kept.append(x)
            if s:
                seen.append(s)
        if not gone or WORD.search("\n".join(kept)):
            out.append((i, "\n".join(kept)))
    return out


def without_near_copies(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return [(i, t) for i, t in rows if comp[i] == i]


def test_stages_and_run_match_plain_python(spark, tmp_path):
    docs, labels, toxic = planted()
    sf = saved(spark, tmp_path, docs, labels)
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{sf}/documents.parquet")

    def after(name, table):
        out = corpus_pipeline.cut(stages[name](spark, table, sf))
        return out, sorted((r.doc_id, r.text) for r in out.collect())

    table, got = after("toxicity", table)
    want = sorted(r for r in docs if r[0] not in toxic)
    assert got == want
    table, got = after("line dedup", table)
    want = without_repeats(want)
    assert got == want and len(want) < 108
    table, got = after("near dedup", table)
    want, before = without_near_copies(want), want
    assert got == want and len(want) < len(before)
    table, got = after("pii", table)
    assert [i for i, _ in got] == [i for i, _ in want]
    swap = {}
    for (_, new), (_, old) in zip(got, want):
        mails = re.findall(r"\S+@\S+", old or "")
        assert re.sub(r"\S+@\S+", "@", new or "") == re.sub(r"\S+@\S+", "@", old or "")
        for a, b in zip(mails, re.findall(r"\S+@\S+", new or "")):
            assert a != b and swap.setdefault(a, b) == b
    assert len(set(swap.values())) == len(swap)
    packed = corpus_pipeline.run(spark, sf).collect()
    count = {}
    for r in packed:
        count[r.doc_id] = count.get(r.doc_id, 0) + r.n_tokens
    assert count == {i: len(WORD.findall(t or "")) for i, t in got}


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a"), (1, None), (1, ""), (2, "  \n\t"), (3, "x" * 70_000 + " y" * 3000), (3, "x y"), (3, "x y")]], ids=["empty", "odd"])
def test_odd_tables(spark, tmp_path, rows):
    sf = saved(spark, tmp_path, rows, [(3, 1, 0), (None, None, None)])
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} <= {i for i, _ in rows} and (not rows or {1, 2} <= {r.doc_id for r in packed})
