"""Host rules, whitening and the Merkle manifest against brute-force versions, with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import host_rules, merkle, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
W = r"[^\x20\x09-\x0D]+"


def _rows():
    rnd = random.Random(5)
    out = []
    for i in range(300):
        host = "bad.example" if i % 10 == 0 else f"host{i % 7}"
        words = [rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randrange(40)) for _ in range(10 if host == "bad.example" and i % 20 else rnd.choice([60, 90, 130]))]
        out.append((i, "Ein " * (i % 3 == 0) + " ".join(words), "en", host, i))
    out += [(301, None, None, None, None), (302, "", "en", None, 0), (303, " \t\n", None, "host1", 3), (304, "a b c " * 40, "en", "one.example", 1)]
    out += [(305, "x y\n \nx y\nx y\n# $ %", "en", "host2", 1), (306, "é漢 ß " * 30, "de", "host2", 1), (307, "long " * 200_000, "en", "host3", 1)]
    out += [(305, "x y\n \nx y\nx y\n# $ %", "en", "host2", 1), (None, "no id", "en", "", 1), (None, "no id", "en", "", 1), (-4, "Minus", "en", "host3", None)]
    return out


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"host": F.lit("clash"), "n": F.lit(1), "s": F.lit("x"), "node": F.lit(2), "block": F.lit(3)}).repartition(5).cache()


def _measures(text):
    t = text or ""
    w = re.findall(W, t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    again = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(W, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again)


def test_host_rules(docs, spark):
    want, fails, n = {}, defaultdict(Counter), Counter()
    for i, t, _, host, _ in ROWS:
        m = want[i] = _measures(t)
        if host is not None:
            n[host] += 1
            fails["short"][host] += m[0] < 50
            fails["repeats"][host] += 100 * m[5] > 50 * m[0]
            fails["symbols"][host] += 10 * m[2] > m[0]
            fails["lines"][host] += 10 * m[4] > 3 * m[3]
    rate, total = Counter(), sum(n.values())
    for f in fails.values():
        p = sum(f.values()) / total
        if p:
            spread = sum(n[h] * (f[h] / n[h] - p) ** 2 for h in n) / (p * (1 - p)) - (len(n) - 1)
            room = total - sum(k * k for k in n.values()) / total - (len(n) - 1)
            m = max(0, room / spread - 1) if spread > 0 else None
            for h in n:
                rate[h] = max(rate[h], p if m is None else (f[h] + m * p) / (n[h] + m))
    assert rate["bad.example"] < sum(1 for i, t, _, h, _ in ROWS if h == "bad.example" and _measures(t)[0] < 50) / n["bad.example"]
    limit = rate["bad.example"] - 0.01
    got = host_rules.quality_rules(docs, limit=limit).collect()
    assert len(got) == len(ROWS)
    where = {i: h for i, _, _, h, _ in ROWS}
    for r in got:
        m, host = want[r.doc_id], where[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[5] > 50 * m[0])
        failed = None if host is None else rate[host] > limit
        assert (r.host, r.host_failed, r.kept) == (host, failed, not r.base_failed and not failed)
        assert host is None or abs(r.host_rate - rate[host]) < 1e-6
    assert any(not r.base_failed and not r.kept for r in got) and any(r.kept for r in got)
    assert host_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_host_prior_without_spread(spark):
    """Equal hosts have one rate; a single host has its own."""
    rows = [(i, "w " * (10 if i % 4 == 0 else 0) + " ".join(map(str, range(60))) if i % 4 else "short", "en", f"h{i // 20}", 1) for i in range(100)]
    assert {r.host_rate for r in host_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()} == {0.25}
    one = spark.createDataFrame([(1, "short", "en", "h", 1), (2, "short", "en", "h", 1)], SCHEMA)
    assert {(r.host_rate, r.kept) for r in host_rules.quality_rules(one).collect()} == {(1.0, False)}


def test_double_double():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(600, 4)) * np.array([1e9, 3, 1e4, 2e2])).astype(np.int64) + 10**12
    mean = [Fraction(int(s), len(x)) for s in x.sum(0)]
    high, low = whitening.outer_sum(*whitening.centred(x, mean))
    for i in range(4):
        for j in range(4):
            exact = sum((int(a) - mean[i]) * (int(b) - mean[j]) for a, b in zip(x[:, i], x[:, j], strict=True))
            size = float(sum((int(a) - mean[i]) ** 2 for a in x[:, i]) * sum((int(a) - mean[j]) ** 2 for a in x[:, j])) ** 0.5
            assert abs(float(Fraction(high[i, j]) + Fraction(low[i, j]) - exact)) < 1e-24 * size
    p, e = whitening.two_product(np.float64(1 + 2.0**-40), np.float64(1 + 2.0**-45))
    assert Fraction(float(p)) + Fraction(float(e)) == Fraction(1 + 2.0**-40) * Fraction(1 + 2.0**-45)


VECTORS = "vec_id long, embedding array<float>, component string, n int"


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    base[:130] = base[0]  # one vector fills a third
    rows = [(i, [float(x) for x in v], "clash", 7) for i, v in enumerate(base)]
    bad = [(900, None, "", 1), (901, [1.0] * 5 + [None], "", 1), (902, [float("nan")] * 6, "", 1), (903, [float("inf")] + [0.0] * 5, "", 1), (904, [1.0], "", 1), (905, [1e30] * 6, "", 1), (906, [], "", 1)]
    rows += [(None, rows[5][1], "", 1), (7, rows[7][1], "", 1)]
    got = whitening.whitened(spark.createDataFrame(rows + bad, VECTORS).repartition(7)).toPandas()
    x = np.floor(64 * np.array([v for _, v, *_ in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    v = np.array([[float(sum((n * int(a) - int(s)) * (n * int(b) - int(t)) for a, b in zip(x[:, i], x[:, j], strict=True)) / Fraction(n) ** 3) for j, t in enumerate(sums)] for i, s in enumerate(sums)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * 6 and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 7))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    for k in range(6):
        part = got[got["component"] == k + 1]
        assert np.allclose(part["explained"], e[k] / e.sum(), rtol=1e-10)
        want = (x - sums / n) @ u[:, k] / np.sqrt(e[k])
        have = part.groupby("vec_id")["whitened"].first()
        sign = np.sign(have[1] * want[1])
        assert np.allclose([have[i] for i in range(400)], sign * want[:400], atol=1e-8)
    deviation = got.groupby("vec_id")["deviation"].first()
    assert [deviation[i] for i in range(400)] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x[:400]]
    assert got["vec_id"].isna().sum() == 6 and (got["vec_id"] == 7).sum() == 12


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "", 1), (2, [1.0, 2.0, 4.0], "", 1), (3, [1.0, 2.0, 5.0], "", 1)], VECTORS)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(flat).collect()}
    assert len(got) == 9 and abs(got[1, 1].explained - 1) < 1e-12 and got[1, 2].whitened is None and got[1, 1].identity_error < 1e-12
    one = whitening.whitened(flat.limit(1)).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, None, None, 0)}
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, "", 1)], VECTORS)).count() == 0


def test_large_deviations():
    x = np.array([[10**15, 3], [5, -(10**9)]])
    assert whitening._deviation(x, 2, [int(s) for s in x.sum(axis=0)]) == [None, None]
    y = np.array([[2 * 10**9, 3], [5, 9]])
    assert whitening._deviation(y, 2, [int(s) for s in y.sum(axis=0)]) == [(2 * 10**9 - 5) ** 2 + 36] * 2


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row, text):
    i, _, lang, source, n = row
    return _h("".join(map(_field, (i, source, lang, n, text))))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, at):
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield at % 16, run
        at //= 16


def _manifest(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups["" if r[3] is None else "=" + r[3]].append(r)
    sources = sorted(groups, key=str.encode)
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees[s] = _tree([_leaf(r, r[1]) for r in groups[s]])
    top = _tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for at, r in enumerate(groups[s]):
            way = [*_path(trees[s], at), *_path(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = _leaf(r, re.sub("[A-Z]+", lambda m: m[0].lower(), r[1])) if hit and r[1] is not None else _leaf(r, r[1])
            for p, run in way:
                now = _h("".join(run[:p]) + now + "".join(run[p + 1 :]))
            proof = _h("".join("".join(run[:p] + run[p + 1 :]) for p, run in way))
            out.append((r[0], _leaf(r, r[1]), trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def test_manifest(docs, spark):
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert got == _manifest(ROWS) and {r[-1] for r in got} == {True, False}
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.manifest(spark.createDataFrame(ROWS[1:2], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == _h("")


def test_manifest_of_many_blocks(spark):
    """A source of several blocks, of three rounds, beside sources of one row."""
    rows = [(i * 3, f"Text {i}", "en", "hot" if i < 9000 else f"s{i}", i) for i in range(9300)]
    got = sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str)
    assert got == _manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_traversal(n):
    leaves = [_h(str(i)) for i in range(n)]
    levels = merkle.levels_of(n)
    tree = _tree(leaves)
    assert len(tree) == levels + 1 and merkle.block_root(leaves, levels) == tree[-1][0]
    for i, way in enumerate(merkle.traversal(leaves, levels)):
        assert way == list(_path(tree, i))
        assert merkle.folded(leaves[i], [(p, "".join(run[:p] + run[p + 1 :])) for p, run in way]) == tree[-1][0]
