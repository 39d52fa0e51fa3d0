"""Operators 11 to 13 against brute force, gradients against differences, held-out accuracy, and edge rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.llm import op03_embeddings, op04_language
from assaygrid.llm import op11_conversations as op11
from assaygrid.llm import op12_merkle as op12
from assaygrid.llm import op13_quality as op13

CONV = "conv_id bigint, turn bigint, role string, text string, part string, cost string, audit string, gaps string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root string, tree string, idx string, score string"

# -- 11 ---------------------------------------------------------------------------------------------------------------


def least_repair(codes, start, goals):
    """(cost, edits) by dynamic programming, row by row."""

    def closed(c):
        c = dict(c)
        for _ in range(3):
            for q, (k, a) in list(c.items()):
                c[op11.AFTER[q]] = min(c.get(op11.AFTER[q], (10**9, "")), (k + 2, a + "I"))
        return c

    now = {start: (0, "")}
    for code in codes:
        after = {}
        for q, (k, a) in closed(now).items():
            for letter, read, to, cost in op11.MOVES[code][q]:
                if read:
                    after[to] = min(after.get(to, (10**9, "")), (k + cost, a + letter))
        now = after
    now = closed(now)
    return min((now[q] for q in goals if q in now), default=None)


def test_search_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        codes = "".join(rng.choice("suaxSUAXduaua") for _ in range(rng.randrange(12)))
        assert op11.cheapest(codes) == least_repair(codes, 0, (0, 3))
        table = {(a, b): (c, e) for a, b, c, e in op11.piece_table(codes)}
        assert table == {(a, b): r for a in range(4) for b in range(4) if (r := least_repair(codes, a, (b,)))}


def report_of(rows):
    """The report of one conversation's rows after damage, plainly."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    seen, codes, faults, initials = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0), ""
    for _, _, role, text in rows:
        initial = role[:1] or " "
        initials += initial
        code = initial if initial in "sua" else "x"
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        if fault:
            faults[fault] += 1
            code = code.upper() if fault == "truncated" else "d"
        seen.add((role, text))
        codes += code
    turns = [t for given, t, _, _ in rows if given]
    cost, audit = least_repair(codes, 0, (0, 3))
    done = "\n".join(f"{r}:{x}" for r, x in op11.replay([r[2:] for r in rows], audit, 0))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(p not in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:])))
    return gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(done.encode()).hexdigest()


def conversation_rows():
    rng = random.Random(2)
    rows = [(1, None, "user", "a."), (1, None, "user", "a."), (1, 3, None, None), (1, 2, "assistant", "b"), (2, None, None, ""), (3, 0, "", "x!"), (3, 1, "System", "y"), (None, 0, "user", "q?"), (None, 1, "assistant", "r.")]
    rows += [(4, i, "ua"[i % 2].replace("u", "user").replace("a", "assistant") if rng.random() > 0.1 else "user", rng.choice(["Yes.", "no", "", f"text {i}.", "é" * 50 + "!"])) for i in range(700)]
    rows += [(5, i // 3, rng.choice(["system", "user", "assistant", "tool"]), rng.choice([f"t{i}.", f"t{i % 7}", " \t"])) for i in range(90)]
    return rows + [(6, 0, "system", "s" * 3_000_000 + "."), (6, 1, "user", "u."), (6, 2, "assistant", "a.")]


@pytest.mark.parametrize("piece", [3, 256])
def test_report_equals_brute_force(spark, piece):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONV)
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(rest)
    got = op11.conversation_report(df, piece=piece).collect()
    assert len(got) == len(by)
    for r in got:
        assert tuple(r)[1:] == report_of(by[r.conv_id]), r.conv_id
    assert op11.conversation_report(df.limit(0)).count() == 0


def test_repaired_turns_obey_the_grammar(spark):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in conversation_rows()], CONV)
    by = defaultdict(list)
    for r in sorted(op11.repaired_turns(df).collect(), key=lambda r: (r.part, r.no, r.place)):
        by[r.conv_id].append(r.role[0])
    for roles in by.values():
        body = roles[1:] if roles[0] == "s" else roles
        assert body and body == ["u", "a"] * (len(body) // 2)


def test_damage_and_absent_rows(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (None, 0, 1)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONV)
    by = defaultdict(list)
    for c, t, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        hit = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        row = [t, "user" if hit == 4 else role or " ", "" if hit == 1 else "One Two" if hit == 2 and text else word(text)]
        by[c] += [row] * (0 if hit == 0 else 2 if hit == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in op11.conversation_report(op11.damaged(df), "gone").collect()}
    assert got == {c: report_of(by[c]) for c in {r[0] for r in rows}}
    gone = spark.createDataFrame([(1, 0, "user", "a.", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    assert tuple(op11.conversation_report(gone, "gone").first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- 12 ---------------------------------------------------------------------------------------------------------------


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sweep(level):
    """(root, for each leaf the siblings (before, after) level by level)."""
    paths = [[] for _ in level]
    under = [[i] for i in range(len(level))]
    while len(level) > 1:
        up, up_under = [], []
        for i in range(0, len(level), 8):
            run = level[i : i + 8]
            for j in range(len(run)):
                for leaf in under[i + j]:
                    paths[leaf].append((run[:j], run[j + 1 :]))
            up.append(H(run))
            up_under.append([x for u in under[i : i + 8] for x in u])
        level, under = up, up_under
    return level[0], paths


def manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H([enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text)])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = sweep([leaf(r, r[1]) for r in by[lang]])
    root, tops = sweep([trees[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        subroot, paths = trees[lang]
        for r, path in zip(by[lang], paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            digest = leaf(r, r[1].translate(lower) if hit and r[1] is not None else r[1])
            for a, b in path + top:
                digest = H([*a, digest, *b])
            proof = H([x for a, b in path + top for x in (*a, *b)])
            out.append((r[0], leaf(r, r[1]), subroot, root, proof, digest, digest == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("langs", [1, 3, 20])
def test_manifest_equals_brute_force(spark, duck_documents, langs, tmp_path):
    rng = random.Random(langs)
    names = [None, "", "de", "é", "Z"] + [f"l{i}" for i in range(30)]
    rows = [(i, rng.choice(["A b", "c", "", None, "É Z" * 9]), names[0] if langs == 1 else names[min(int(rng.expovariate(0.6)), langs - 1)], rng.choice(["s", None]), rng.choice([3, None])) for i in range(150)]
    rows += [(7, "A b", None, "s", 3)] * 3 + [(None, "Q", "de" if langs > 1 else None, "s", 1), (2, None, None, None, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op12.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == manifest(rows)
    assert got == sorted(duck_documents(tmp_path, op12.op12_sql()), key=repr)
    assert op12.merkle_manifest(df.limit(0)).count() == 0


@pytest.fixture
def duck_documents():
    def run(folder, sql):
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        return con.sql(sql).fetchall()

    return run


def test_untampered_manifest_verifies(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", 2, "a", "b", "c", "d", "e") for i in range(70)], DOCS)
    rows = op12.merkle_manifest(df).collect()
    assert all(r.verified and len(r.path) == 3 for r in rows)


# -- 13 ---------------------------------------------------------------------------------------------------------------


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = op13.start_weights(1)
    net = op13.Network(*[w.astype(np.float64) for w in net])
    x, at = rng.random((9, op13.FEATURES)) * 0.1, np.array([0, 1, 4, 9])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 3.0, 0.5])

    def loss(n):
        h, _, _, e = op13.encoded(n, x)
        total = 0.0
        for i in range(3):
            part = slice(at[i], at[i + 1])
            a = np.exp(e[part] - e[part].max())
            p = op13.sigmoid(a @ h[part] / a.sum() @ n.out + n.bias[0])
            total -= weight[i] * (np.log(p) if y[i] else np.log(1 - p))
        return total / weight.sum()

    grads = op13.gradients(net, x, at, y, weight)
    for k in range(len(net)):
        for place in [tuple(rng.integers(0, s) for s in net[k].shape) for _ in range(4)]:
            up, down = [op13.Network(*[w.copy() for w in net]) for _ in range(2)]
            up[k][place] += 1e-5
            down[k][place] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grads[k][place]) < 1e-5, (k, place)


def quality_rows(n):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(200)) + "."
    bad = lambda: " ".join("".join(rng.choice("ETAOIN") for _ in range(4)) + "!!" for _ in range(200))
    return [(i, good() + " " + good() if i % 3 else good() + " " + bad()) for i in range(n)]


def test_quality_learns_from_bags(spark):
    rows = quality_rows(300)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c", "d", "e") for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    got = op13.score_quality(docs, labels, examples=200, passages=2000, steps=150).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "x y"), (4, "A b " * 700_000), (4, "A b " * 700_000), (5, "é" * 3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c", "d", "e") for i, t in rows], DOCS)
    labels = lambda *x: spark.createDataFrame(list(x), "doc_id bigint, quality int, toxic int")
    keyed = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert {r[2] for r in keyed(op13.score_quality(docs, labels()))} == {0.0}
    assert {r[2] for r in keyed(op13.score_quality(docs, labels((2, 1, 0), (3, 1, 0))))} == {1.0}
    got = keyed(op13.score_quality(docs, labels((2, 1, 0), (3, 0, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (1, 7, 0)), steps=5))
    assert len(got) == 7 and all(0 <= r[2] <= 1 for r in got) and got.count(got[[r[0] for r in got].index(4)]) == 2
    assert op13.score_quality(docs.limit(0), labels((2, 1, 0), (3, 0, 0))).count() == 0


def test_slices_give_the_same_score(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["Word", "other,", "THIRD!!", "x" * 40]) for _ in range(2000)).encode()
    data, offs = np.frombuffer(text + b"short", np.uint8), np.array([0, len(text), len(text), len(text) + 5])
    net, encode = op13.start_weights(2), op13.Passages()
    whole = op13.score_bags(net, encode, data, offs)
    monkeypatch.setattr(op13, "SLICE_BYTES", 2048)
    cut = op13.score_bags(net, encode, data, offs)
    assert np.allclose(whole[0], cut[0], atol=2e-3) and np.array_equal(whole[1], cut[1]) and list(whole[1][1:]) == [1, 1]


# -- 3 and 4: findings of the last round --------------------------------------------------------------------------------


def test_one_vec_id_with_several_vectors_joins_their_classes(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a, 0), (5, a, 0), (5, b, 0), (9, b, 0), (11, c, 0), (11, c, 1), (12, c, 1), (4, None, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id, r.component_id, r.kept) for r in op03_embeddings.embedding_duplicates(df).collect())
    assert got == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (9, 3, False), (11, 11, True), (11, 11, True), (12, 11, False)]


def test_copies_of_a_text_are_one_example(spark):
    """A language of one text that is repeated often is learned beside one of many texts."""
    rng = random.Random(1)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    one = text("zyxwv", 60)
    for examples in (4000, 20):
        rows = [(i, one, "zz") for i in range(1500)] + [(5000 + i, text("abcdeo", 40), "bb") for i in range(120)]
        df = spark.createDataFrame([(i, t, g, "s", 1, "a", "b", "c", "d", "e") for i, t, g in rows], DOCS)
        got = op04_language.identify_language(df, examples=examples).collect()
        assert {r.lang_pred for r in got if r.doc_id < 5000} == {"zz"} and {r.lang_pred for r in got if r.doc_id >= 5000} == {"bb"}
