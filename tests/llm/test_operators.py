"""Every corpus operator against a brute-force version, on texts with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import exact_dedup, fingerprint, langid, license_scan, packing, pieces, pii, recompression, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is that it was for with on as be at by this from they are".split(),
    "de": "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}


def _texts():
    rnd = random.Random(11)
    out = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        words = [rnd.choice(WORDS[lang]) + rnd.choice(["", "", "en", "tion", "er"]) for _ in range(rnd.choice([3, 20, 60, 150]))]
        out.append((i, " ".join(words), lang))
    base = out[5][1]
    out += [(100, base, "fr"), (101, base.replace(" ", "\n "), "fr"), (102, base + " zusatz", "fr"), (103, " ".join([base, out[8][1], base]), "fr")]
    out += [(110, "", None), (111, None, "en"), (112, " \t\n", None), (113, "12345 !!", "en"), (114, "x" * 5000, None), (115, "a " * 400, None), (116, "a b " * 200, None)]
    out += [(120, "mail joe.x@mail.example.com or joe (at) foo (dot) com, +1 (555) 555-0100 and 10.0.0.256 10.0.0.255 4111 1111 1111 1111", "en")]
    out += [(121, "Released under the MIT License. x y z. Licensed under the Apache License, Version 2.0. end", "en"), (122, "é漢 a@b.c ß " * 30, "de")]
    return [(i, t, lang, "s", len(t) if t else 0) for i, t, lang in out]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).withColumns({"words": F.lit("clash"), "fp": F.lit(1), "spans": F.lit(2), "low": F.lit("x")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, *_ in TEXTS}
    groups = defaultdict(list)
    for i, t, *_ in TEXTS:
        groups[norm[i]].append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, r in got.items():
        g = groups[norm[i]]
        assert (r.keep_id, r.group_size, r.kept) == (min(g)[1], len(g), min(g)[1] == i)
        assert r.text_sha256 == hashlib.sha256(norm[i].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_without_ids(spark):
    rows = spark.createDataFrame([(None, "a", None, None, None), (3, "a ", None, None, None), (3, "a ", None, None, None)], SCHEMA)
    assert sorted((r.doc_id or -1, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(rows).collect()) == [(-1, 3, False), (3, 3, True), (3, 3, True)]


def test_simhash(docs, empty):
    def slow(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [simhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = {i: slow(t) for i, t, *_ in TEXTS}
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in fp}
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("few", [1, 1024])
def test_simhash_links_of_a_crowd(spark, few, monkeypatch):
    """A dense ball of fingerprints, by pairs and by completing the ball, ties what all pairs tie."""
    rnd = random.Random(few)
    fps = {0x0123456789ABCDEF}
    for _ in range(120):
        x = rnd.choice(sorted(fps))
        for _ in range(rnd.choice([1, 2, 4, 5])):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    a = np.array(sorted(fps), np.uint64)
    monkeypatch.setattr(simhash, "FEW", few)
    ties = simhash.links(spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")).collect()

    def classes(pairs):
        root = {int(x): int(x) for x in a.view(np.int64)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in pairs:
            root[find(u)] = find(v)
        out = defaultdict(set)
        for x in root:
            out[find(x)].add(x)
        return {frozenset(x) for x in out.values()}

    signed = a.view(np.int64)
    want = [(int(signed[i]), int(signed[j])) for i in range(len(a)) for j in range(i) if int(a[i] ^ a[j]).bit_count() <= 4]
    assert classes([(t.u, t.v) for t in ties]) == classes(want)
    assert all(((t.u ^ t.v) & (2**64 - 1)).bit_count() <= 4 for t in ties)


def test_substring_dedup(docs, empty):
    words = {i: (t or "").encode().split() for i, t, *_ in TEXTS}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][s : s + 13]), i)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.substring_dedup(docs).collect()}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < i:
                gone |= set(range(s, s + 13))
        kept = [x for n, x in enumerate(w) if n not in gone]
        assert got[i] == (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()), i
    assert recompression.substring_dedup(empty).count() == 0


def _slow_substring(rows):
    """(n_words, n_removed, kept_sha256) of each (doc_id, text), by all windows."""
    last = 1 << 62
    rows = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in rows:
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in rows:
        gone = {s + k for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for k in range(13)}
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((None if i == last else i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substring_dedup_of_repeated_and_missing_ids(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(WORDS["en"]) + str(rnd.randrange(40)) for _ in range(n))
    common, line = text(60), text(13)
    giant = " ".join([text(4000), common, line * 1, text(3000), "la " * 500, line, text(5000)])
    rows = [(1, common), (5, text(100) + " " + common), (5, "four small words only"), (5, text(160)), (None, text(100) + " " + common), (None, "a few words"), (None, common), (7, giant), (9, giant), (9, giant), (4, "la " * 40), (2, line)]
    rows += [(20 + i, f"{text(20)} {line} {text(20)}") for i in range(60)] + [(None, None), (30, "")]
    got = recompression.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(_slow_substring(rows), key=key)


def test_pii(docs, empty):
    strict = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t, *_ in TEXTS:
        base = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(strict.items()) for m in re.finditer(p, t or "") if good(kind, m[0]))
        named = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in named) for k in pii.KINDS]
    assert pii.find_pii(empty).count() == 0
    clean = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert clean[120].text.startswith("mail [EMAIL] or") and "[PHONE]" in clean[120].text and "[CARD]" in clean[120].text and "10.0.0.256" in clean[120].text
    assert clean[111].text is None and clean[0].text == TEXTS[0][1] and clean[120].n_chars == len(clean[120].text)
    assert pii.redacted(docs).columns == docs.columns


def test_pii_of_a_text_with_many_spans(spark):
    """Places, overlaps and redaction beyond one block of spans and one block of characters."""
    parts = []
    for i in range(700):
        parts += [f"u{i}@mail{i}.example.org", "é漢 " * (i % 7), f"10.0.{i % 256}.{i % 300}", "x" * (i * 3 % 90), "4111 1111 1111 1111 " * (i % 2)]
    text = " ".join(parts)
    spans = [(m.start(), m.end()) for m in re.finditer(pii.STRICT["email"][1].replace(r"\G|", ""), text)]
    row = pii.find_pii(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")).first()
    assert row.n_email == len(spans) == 700 and {f"email:{a}:{b}" for a, b in spans} <= set(row.spans.split(","))
    found = sorted((int(a), int(b), k.upper()) for k, a, b in (x.split(":") for x in row.spans.split(",")))
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    clean = pii.redacted(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")).first()
    assert clean.text == "".join(out) + text[at:] and clean.n_chars == len(clean.text)


def test_pii_estimates_reliabilities(spark):
    """The counted votes give what expectation-maximisation over every single candidate gives."""
    rnd = random.Random(5)
    votes = []
    for _ in range(400):
        true = rnd.random() < 0.4
        votes.append((0, *[rnd.choice([0, 1 if (rnd.random() < q) == true else -1]) for q in (0.95, 0.9, 0.7, 0.6, 0.55)]))
    rows = spark.createDataFrame([([v],) for v in votes], "spans array<struct<kind:int,strict:int,check:int,known:int,cue:int,edge:int>>")
    model = pii.fit(rows, rounds=4)
    p = [1 / (1 + np.exp(-sum(v[1:]))) for v in votes]
    for _ in range(4):
        yes, no = sum(p), len(p) - sum(p)
        odds = [np.log((yes + 1) / (no + 1))] * len(votes)
        right = {}
        for j, name in enumerate(pii.LABELERS, 1):
            n = {(v, y): 1 + sum(q if y else 1 - q for q, w in zip(p, votes) if w[j] == v) for v in (-1, 1) for y in (0, 1)}
            all_yes, all_no = n[-1, 1] + n[1, 1], n[-1, 0] + n[1, 0]
            odds = [o + (np.log(n[w[j], 1] / all_yes * all_no / n[w[j], 0]) if w[j] else 0.0) for o, w in zip(odds, votes)]
            right[0, name] = (n[1, 1] + n[-1, 0]) / (all_yes + all_no)
        p = [1 / (1 + np.exp(-o)) for o in odds]
    assert model.accuracy == pytest.approx(right)


def test_license_scan(docs, empty):
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {(121, "MIT"), (121, "Apache-2.0")}
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_recall(spark):
    """Against all shingles of all templates in all texts, with words of the templates changed and cut off."""
    rnd = random.Random(8)
    word = re.compile(r"[^\W_]+(?:\.(?=\d)\d+)?")

    def shingles(t):
        w = word.findall(t.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    rows = []
    for _, text in license_scan.TEMPLATES:
        for k in range(8):
            w = text.split()
            if k % 4 == 1:
                w[rnd.randrange(len(w))] = "changed"
            elif k % 4 == 2:
                w = w[rnd.randrange(2) :]
            elif k % 4 == 3:
                w = w[: len(w) - rnd.randrange(3)]
            some = lambda: [rnd.choice(WORDS["en"]) for _ in range(rnd.randrange(40))]
            rows.append((len(rows), " ".join([*some(), *w, *some()])))
    want = set()
    for i, text in rows:
        own = shingles(text)
        for name, template in license_scan.TEMPLATES:
            wanted = set(shingles(template))
            n = len(shingles(template))
            if any(len(set(own[max(j - n, 0) : max(j - n, 0) + 2 * n + 2]) & wanted) >= 0.8 * len(wanted) for j, x in enumerate(own) if x in wanted):
                want.add((i, name))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 40


def test_language_id_is_the_nearest_centroid(docs):
    """Every prediction, from the fitted model, by a plain search over all centroids."""
    model = langid.fit(docs.where(langid.learned_from()))
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert model.langs == ["de", "en", "fr"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    for i, t, *_ in TEXTS:
        cleaned = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not cleaned:
            continue
        n = langid.counts(f" {' '.join(cleaned)} ")
        v = np.log1p(n) * model.idf
        cosines = [float(v @ c / np.linalg.norm(v)) for c in model.centroids]
        assert got[i].score == pytest.approx(max(cosines), abs=1e-4)
        assert got[i].lang_pred in {model.langs[model.of[k]] for k, c in enumerate(cosines) if c > max(cosines) - 1e-5}


def test_language_id(docs, empty):
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t, *_ in TEXTS:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[i].score <= 1
    held = [i for i, t, lang, *_ in TEXTS if got[i].held_out and i < 90 and len(t) > 100]
    right = sum(got[i].lang_pred == TEXTS[i][2] for i in held)
    assert right / len(held) >= 0.95 and not any(got[i].rejected for i in held)
    assert got[113].rejected and got[111].rejected
    assert langid.language_id(empty).count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.best_fit_packing(docs).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in TEXTS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        for r in parts:
            cut = ids[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and r.length == len(cut) and r.ids_crc32 == zlib.crc32(cut.tobytes())
        assert sum(r.length for r in parts) == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r.length for r in rows) // 2048)
    assert packing.best_fit_packing(empty).count() == 0


def test_bin_completion_beats_best_fit():
    counts = {4: 2, 3: 4}
    best = packing.pack(counts, 10)
    assert len(packing.best_fit(counts, 10)) == 3 and len(best) == 2 and sorted(x for f in best for x in f) == sorted(x for x, n in counts.items() for _ in range(n))
    rnd = random.Random(2)
    for _ in range(50):
        counts = {x: rnd.randrange(1, 4) for x in rnd.sample(range(1, 50), 8)}
        got = packing.pack(counts, 50)
        assert sorted(x for f in got for x in f) == sorted(x for x, n in counts.items() for _ in range(n))
        assert all(sum(f) <= 50 for f in got) and len(got) <= len(packing.best_fit(counts, 50))


def test_bin_completion_is_exact_on_small_tasks():
    """Against trying all ways; and the fillings offered are all the undominated ones."""
    rnd = random.Random(1)

    def fewest(items, length):
        best = [len(items)]

        def put(i, bins):
            if len(bins) < best[0]:
                if i == len(items):
                    best[0] = len(bins)
                    return
                for k in range(len(bins)):
                    if bins[k] + items[i] <= length and bins[k] not in bins[:k]:
                        put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
                put(i + 1, [*bins, items[i]])

        put(0, [])
        return best[0]

    for _ in range(120):
        length = rnd.choice([10, 20, 50])
        items = sorted((rnd.randrange(1, length * 2 // 3) for _ in range(rnd.randrange(1, 10))), reverse=True)
        counts = {x: items.count(x) for x in items}
        got = packing.pack(counts, length, nodes=10_000)
        assert sorted((x for f in got for x in f), reverse=True) == items and all(sum(f) <= length for f in got)
        assert len(got) == fewest(items, length)
        left = packing._Counts(counts, length)
        offered = [tuple(sorted(f)) for f in packing.completions(left, length, packing._Budget(100_000))]
        ways = {tuple(sorted(x for x, take in zip(items, f"{m:0{len(items)}b}", strict=True) if take == "1")) for m in range(1 << len(items))}
        ways = {w for w in ways if sum(w) <= length}
        kept = set()
        for w in ways:
            for x in w:
                left.take(x)
            if not packing.dominated(left, w, length - sum(w)):
                kept.add(w)
            for x in w:
                left.put(x)
        assert len(offered) == len(set(offered)) and set(offered) == kept
        assert left.n == counts


def test_fingerprints_by_whole_shingle_sets(docs):
    """Independent of the operator's hashes: likeness is the Jaccard similarity of the five-word shingle sets."""
    text = {i: t or "" for i, t, *_ in TEXTS}
    ids = sorted(text)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in fingerprint.edits_and_neighbours(docs).collect():
        own, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(own) // 2
        assert r.near_edited == jaccard(shingles(own), shingles(own[: len(own) - half] + after[:half])) and r.near_next == jaccard(shingles(own), shingles(after))
    a, b = text[5], text[8]
    joined = fingerprint.merged(fingerprint.sketch(a, scale=4), fingerprint.sketch(b, scale=4))
    assert set(joined.tolist()) == set(fingerprint.sketch(a, scale=4).tolist()) | set(fingerprint.sketch(b, scale=4).tolist())


def test_fingerprints(docs, empty):
    ids = sorted(i for i, *_ in TEXTS)
    text = {i: t or "" for i, t, *_ in TEXTS}
    got = {r.doc_id: r for r in fingerprint.edits_and_neighbours(docs).collect()}
    assert len(got) == len(TEXTS)
    for n, i in enumerate(ids):
        after, own = text[ids[(n + 1) % len(ids)]], text[i]
        new = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        a, b, c = (fingerprint.sketch(x) for x in (own, new, after))
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (fingerprint.shown(a), fingerprint.shown(b))
        assert got[i].near_edited == fingerprint.likeness(a, b) and got[i].near_next == fingerprint.likeness(a, c)
    assert got[5].fingerprint == got[100].fingerprint
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()} == {i: r.fingerprint for i, r in got.items()}
    assert fingerprint.edits_and_neighbours(empty).count() == 0


def test_fingerprint_estimates_containment():
    rnd = random.Random(4)
    long = " ".join(str(rnd.random()) for _ in range(8000))
    part = " ".join(long.split()[1000:3000])
    a, b = fingerprint.sketch(part), fingerprint.sketch(long)
    assert fingerprint.containment(a, b) > 0.99 and abs(fingerprint.likeness(a, b) - 0.25) < 0.08


def test_url_filter(spark):
    urls = ["http://A.Example.COM/en/7x?q", "http://example.com/en/8", "https://x.net/de/8", "https://example.net/de/81#a", "http://b.example.net/de/7", "ftp://org/es/", "http://org?x", "no scheme", None, "", "://com/en/", "http://notcom/en/", "http://a.com", "http://xexample.com/en/7"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")

    def slow(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        path, host = path if path.startswith("/") else "", host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(rows).collect()}
    assert got == {i: slow(u) for i, u in enumerate([*urls, urls[0]])}
    assert url_filter.url_filter(rows.where("false")).count() == 0 and url_filter.url_filter(rows, ()).where("verdict = 'allow'").count() == len(urls) + 1


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS", 2)
    listed = spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = url_filter.Cascade("c", listed, universe)
    got = {r.key for r in cascade.attached(universe).where(cascade.contains(F.col("key"))).collect()}
    assert len(cascade.levels) > 2 and got == {f"k{i * 7}" for i in range(300)}
    monkeypatch.setattr(url_filter, "BITS", 12)
    parts = url_filter.cascades("c", listed, universe, 1 << 11)
    named = universe.withColumn("a", F.col("key")).withColumn("va", F.lit(None).cast("string"))
    assert len(parts) > 1 and {r.key for r in url_filter.marked(named, ["a"], "x", parts).where("va = 'x'").collect()} == got


def test_sentencepiece(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(pieces, "TASK", 256)
    library = pieces.lattice(None).library
    encoded = pieces.encode(docs, giant=200, chunk=64)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t, *_ in TEXTS}
    back = {r.doc_id: r for r in pieces.decode(encoded).collect()}
    assert all(back[i].text == (t or "") and back[i].n_ids == len(got[i]) for i, t, *_ in TEXTS)
    assert pieces.encoded_and_decoded(empty).count() == 0


def test_max_plus_product_is_associative():
    rnd = random.Random(1)
    a, b, c = ({i: {j: 0 for j in range(4) if rnd.random() < 0.5} for i in range(4)} for _ in range(3))
    assert pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))
