import random

import numpy as np
import pyarrow as pa
from tessera.llm import line_dedup as L
from tessera.llm.text_arrays import strings, words

from .helpers import docs, empty, sentence


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            b.insert(rng.randint(0, len(b)), rng.choice("abx")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        b = "".join(b)
        d = distance(a, b)
        for most in range(0, 15):
            assert L.within(a, b, most) == (d <= most)


def test_aligned_words_prove_no_more_than_the_distance():
    rng = random.Random(3)
    proved = 0
    for _ in range(400):
        a = [rng.choice(["a", "bc", "def", "ghij", "klé"]) for _ in range(rng.randint(1, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = [rng.choice(["a", "xyz", "ghij", ""])] * rng.randint(0, 2)
        a, b = " ".join(a), " ".join(b)
        d = distance(a, b)
        for most in (0, 1, 3, 6, 10):
            got = L.aligned(a, b, most)
            assert not got or d <= most
            proved += got
        assert L.similar(a, b) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert proved > 200


def test_fingerprint_of_a_line_of_many_words():
    words_of = ["abcdef", "ghijkl", "mnopqr"]
    line = " ".join(words_of[i % 3] for i in range(40_000))
    w = words(strings(pa.array([line, "abcdef ghijkl mnopqr"])))
    _, _, first, end = L.line_words(w)
    whole = L.fingerprints(w, first, end)
    assert (whole == L.fingerprints(w, first, end, step=1 << 9)).all()
    # Each of the three words counts a third of all, so a bit is set where two of them have it.
    assert (whole[0] == whole[1]).all()


def form(line):
    return " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())


def expected(texts):
    """Kept lines by brute force over all pairs of lines."""
    lines = [(i, j, form(x)) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    group = list(range(len(lines)))
    for p in range(len(lines)):
        for q in range(p):
            a, b = lines[p][2], lines[q][2]
            if a == b or (max(len(a), len(b)) * 0.2 >= abs(len(a) - len(b)) and distance(a, b) <= max(len(a), len(b)) * 0.2):
                old, new = group[p], group[q]
                group = [new if g == old else g for g in group]
    first = {}
    for k, (i, j, _) in enumerate(lines):
        first.setdefault(group[k], (i, j))
    return {(i, j) for k, (i, j, _) in enumerate(lines) if first[group[k]] != (i, j)}


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [sentence(rng, rng.randint(15, 40)) for _ in range(12)]
    texts = []
    for _ in range(30):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(pool) if rng.random() < 0.5 else sentence(rng, rng.randint(6, 30))
            if rng.random() < 0.4:
                line = line.upper() + " !"
            lines.append(line)
        texts.append("\n".join(lines))
    # One letter less in a long line leaves nearly all words, and so nearly all bits.
    long = sentence(rng, 60)
    texts += [long, long[:-1], "\n\n" + long.title()]
    out = L.dedup(docs(spark, texts)).collect()
    got = {(r.doc_id, j) for r in out for j in r.removed_lines}
    assert got == expected(texts)
    for r in out:
        lines = texts[r.doc_id].split("\n")
        assert r.text == "\n".join(x for j, x in enumerate(lines) if j not in r.removed_lines) and r.n_lines == len(lines)


def met(pairs):
    """Which pairs of lines share a key."""
    got = []
    for k in range(2):
        w = words(strings(pa.array([p[k] for p in pairs]), lower=True))
        _, line, first, end = L.line_words(w)
        batch = pa.record_batch([L.prints(w, first, end), pa.array(range(len(pairs)), pa.int64())], ["print", "node"])
        got.append({(r["key"], r["node"]) for b in L.block_keys(iter([batch])) for r in b.to_pylist()})
    return {node for _, node in got[0] & got[1]}


def test_altered_words_are_met():
    """Pairs within the edit similarity that differ in one or two words: recall against all pairs that hold."""
    rng = random.Random(9)
    for n, most in ((5, 2), (8, 2), (12, 2), (20, 2), (30, 2)):
        for edits in range(1, most + 1):
            pairs = []
            for _ in range(300):
                line = sentence(rng, n).split()
                new = list(line)
                for i in rng.sample(range(n), edits):
                    at = rng.randrange(len(new[i]))
                    new[i] = new[i][:at] + rng.choice("qrstuvwxyz") + new[i][at + rng.randrange(2) :]
                if distance(" ".join(line), " ".join(new)) <= 0.2 * max(len(" ".join(line)), len(" ".join(new))):
                    pairs.append((" ".join(line), " ".join(new)))
            assert len(pairs) > 200
            assert len(met(pairs)) >= (1.0 if edits == 1 and n <= 20 or n <= 12 else 0.97) * len(pairs), (n, edits)


def test_one_typo_in_a_short_line_is_removed(spark):
    a = "the quick brown foxes jumped over lazy sleeping dogs"
    texts = [a, "another line altogether stands here\n" + a.replace("jumped", "jumqed"), a.replace("lazy", "lasy").replace("brown", "brawn")]
    got = {(r.doc_id, j) for r in L.dedup(docs(spark, texts)).collect() for j in r.removed_lines}
    assert got == expected(texts) == {(1, 1), (2, 0)}


def test_awkward_rows(spark):
    texts = ["NULLID", None, "", "---\n\n---", "a b c\na b c", "a b c", "x " * 3000 + "\n" + "x " * 3000]
    out = {r.doc_id: r for r in L.dedup(docs(spark, texts)).collect()}
    assert len(out) == 7
    assert out[1].text == "" and out[2].text == "" and out[3].text == "---\n\n---" and out[4].text == "a b c" and out[5].text == ""
    assert out[6].removed_lines == [1] and out[None].removed_lines == []
    assert L.dedup(empty(spark)).count() == 0
    twice = docs(spark, ["same line here"]).unionByName(docs(spark, ["same line here"]))
    assert [r.text for r in L.dedup(twice).collect()] == ["same line here"] * 2


def test_recall_of_one_word_edits():
    """One word replaced, one letter changed, a word deleted, a word inserted: pairs that hold must meet."""
    rng = random.Random(12)
    edits = {
        "replaced": lambda w, i: w[:i] + [sentence(rng, 1)] + w[i + 1 :],
        "letter": lambda w, i: w[:i] + [w[i][:-1] + rng.choice("qrstuvwxyz")] + w[i + 1 :],
        "deleted": lambda w, i: w[:i] + w[i + 1 :],
        "inserted": lambda w, i: w[:i] + [sentence(rng, 1)] + w[i:],
    }
    for n in (6, 10, 20, 40):
        for name, edit in edits.items():
            pairs = [(" ".join(w), " ".join(edit(w, rng.randrange(n)))) for w in (sentence(rng, n).split() for _ in range(300))]
            pairs = [p for p in pairs if distance(*p) <= 0.2 * max(map(len, p))]
            assert len(pairs) > 100 and len(met(pairs)) >= 0.9 * len(pairs), (n, name)


def test_lines_of_one_long_passage_are_not_paired(spark, monkeypatch):
    """Lines around a common passage share buckets; few are similar, and their pairs are not joined."""
    rng = random.Random(23)
    passage, texts = sentence(rng, 40), []
    for k in range(160):
        texts.append(f"{sentence(rng, rng.randint(4, 40))} {passage}" + f" {sentence(rng, 12)}" * (k % 3 == 0))
        if k % 8 == 0:
            w = texts[-1].split()
            texts.append(" ".join([*w[:2], w[2] + "q", *w[3:]]))
    w = words(strings(pa.array(texts), lower=True))
    _, _, start, end = L.line_words(w)
    batch = pa.record_batch([L.prints(w, start, end), pa.array(range(len(texts)), pa.int64())], ["print", "node"])
    keys = [set() for _ in texts]
    for b in L.block_keys(iter([batch])):
        for r in b.to_pylist():
            keys[r["node"]].add(r["key"])
    group = list(range(len(texts)))
    for p in range(len(texts)):
        for q in range(p):
            if group[p] != group[q] and keys[p] & keys[q] and L.similar(form(texts[p]), form(texts[q])):
                group = [group[q] if g == group[p] else g for g in group]
    got, link = [], L.link
    monkeypatch.setattr(L, "link", lambda buckets, verify, narrow, tables: link(buckets, lambda pairs: got.append(pairs.count()) or verify(pairs), narrow, tables))
    removed = {r.doc_id for r in L.dedup(docs(spark, texts)).collect() if r.removed_lines}
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert removed == {i for i, g in enumerate(group) if first[g] != i} and len(removed) > 10
    assert sum(got) < 12 * len(texts)


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    """Several blocks and classes of lengths: the groups of all pairs of a bucket."""
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = random.Random(24)
    lines = [sentence(rng, rng.randint(3, 12)) for _ in range(25)]
    lines += [x[: rng.randint(int(0.78 * len(x)), len(x))] for x in lines] + [x + " " + x[: len(x) // 5] for x in lines]
    tables = L.Tables(spark)
    rows = spark.createDataFrame([(k, [1, 2], i, i, x) for i, x in enumerate(lines) for k in (1, 2)], "key long, keys array<long>, node long, comp long, form string")
    found = {(r.a, r.b) for r in L.large_links(rows, tables).collect()}
    held = {(i, j) for j in range(len(lines)) for i in range(j) if L.similar(lines[i], lines[j])}

    def groups(pairs):
        root = list(range(len(lines)))
        for i, j in pairs:
            root = [root[i] if r == root[j] else r for r in root]
        return [root.index(r) for r in root]

    assert found <= held and len(held) > 25 and groups(found) == groups(held)


def test_features_of_a_line_are_taken_once(monkeypatch):
    """The fingerprints and the MinHash keys come from one pass, and are those of two."""
    rng = random.Random(33)
    w = words(strings(pa.array(["\n".join(sentence(rng, n) for n in (1, 3, 8, 15, 16, 17, 40, 90)) for _ in range(5)])))
    _, _, first, end = L.line_words(w)
    calls, features = [], L.features
    monkeypatch.setattr(L, "features", lambda *x: calls.append(x) or features(*x))
    got = [np.frombuffer(x, np.uint32) for x in L.prints(w, first, end).to_pylist()]
    assert len(calls) == 1
    long = np.flatnonzero(end - first >= L.SKETCHED)
    keys = L.minima(*features(w, first[long], end[long]), len(long))
    assert (np.stack([got[i][L.BLOCKS : L.BLOCKS + L.TABLES] for i in long]) == keys).all()
    assert (np.stack([x[: L.BLOCKS] for x in got]) == np.ascontiguousarray(L.fingerprints(w, first, end)).view(np.uint32)).all()


def test_few_pairs_of_blocks_are_few_tasks(spark, monkeypatch):
    """A task costs more than the comparisons of a small block: 20 buckets of one block, in a few classes of lengths, are a few tasks."""
    lines = [sentence(random.Random(i), 8) for i in range(6)]
    rows = spark.createDataFrame([(k, [k], i, i, x) for i, x in enumerate(lines) for k in range(20)], "key long, keys array<long>, node long, comp long, form string")
    asked, repartition = [], type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, n, *cols: asked.append(n) or repartition(self, n, *cols))
    assert L.large_links(rows, L.Tables(spark)).count() == 0
    assert len(asked) == 1 and asked[0] <= 20 * 6 // L.EACH
