import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import archive, decontamination, licenses, ngram_join, queries, repetition, suffix_dedup, suffix_sort, toxicity
from leadloom.llm.oracles import ORACLES
from leadloom.plans.storage import shared_dir


def brute_repetition(t):
    w = (t or "").encode().split()
    n = len(w)
    best = [max((next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    hit = {j for i in range(n - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    covered = {j for i, k in enumerate(best) if k >= 5 for j in range(i, i + k)}
    return n, len(hit), max(best, default=0), len(covered)


def test_repetition_equals_brute_force(frame):
    random.seed(2)
    texts = ["".join(random.choice("ab \n") for _ in range(random.randint(0, 70))) for _ in range(80)] + ["", None, "x" * 50, "a " * 120, " \n\t", "#$ é|", "w " + "one two three four five six " * 2]
    words = [f"w{i}" for i in range(400)]
    texts += [" ".join(w + w[5 : 5 + k]) for k in (5, 12, 40, 60) for w in (random.sample(words, 300),)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = repetition.repetition_quality(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]] or ""
        n, hit, longest, covered = brute_repetition(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r["n_words"], r["n_repeat_words"], r["longest_repeat"]) == (n, hit, longest)
        assert r["n_symbols"] == sum(t.count(x) for x in "#*$%&|<>") and r["n_dup_lines"] == len(lines) - len(set(lines)) and r["word_chars"] == len(re.sub(r"[\x20\x09-\x0d]", "", t))
        assert r["base_failed"] == (n < 10 or 100 * hit > 20 * n)
        assert r["n_covered_words"] == covered and abs(r["covered_share"] - covered / max(1, n)) < 1e-12
        assert r["kept"] == (not r["base_failed"] and covered <= 0.2 * n and longest <= 50)
    assert repetition.repetition_quality(frame(rows).limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    big, small = "<p>é" * 400, "<p>tiny"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\r\n3", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", big + "x"), (2, "again", big), (9, "u", "WARC/1.1\r\n\r\n" + big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = shared_dir(spark, "a")
    archive.write_archive(pages, path)
    got = archive.read_archive(spark, path).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    html = {(i, h or "") for i, _, h in rows}
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in got} == html
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (9, "response", None)]
    assert spark.read.parquet(f"{path}/payloads").count() == len({h for _, h in html})
    one = archive.record_bytes(archive.read_archive(spark, path)).filter("page_id = 1").first()["record"]
    assert bytes(one).startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and bytes(one).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    archive.export_warc(archive.read_archive(spark, path).filter("page_id in (1, 9)").coalesce(1), str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    want = b"".join(sorted(bytes(r["record"]) for r in archive.record_bytes(archive.read_archive(spark, path)).filter("page_id in (1, 9)").collect()))
    written = b"".join(f.read_bytes() for f in files)
    assert len(written) == len(want) and all(bytes(r["record"]) in written for r in archive.record_bytes(archive.read_archive(spark, path)).filter("page_id in (1, 9)").collect())
    empty = shared_dir(spark, "a")
    archive.write_archive(pages.limit(0), empty)
    assert archive.read_archive(spark, empty).count() == 0


def brute_contamination(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    spans = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(s) for s in spans}
    out = []
    for d, t in docs:
        w, hit, named = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = spans.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    named |= found
        out.append((d, len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, frame):
    random.seed(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([3, 12, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, " , "), (52, "ÉCOLE école"), (1, "w1 w2 w3")]
    docs = []
    for i in range(60):
        parts = [" ".join(random.choice(words) for _ in range(random.randint(0, 40)))]
        if i % 2:
            w = (random.choice(items)[1] or "").split()
            parts.insert(random.randint(0, 1), " ".join(w[random.randint(0, 2) :]).upper())
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "w1"), (5, docs[7][1]), (None, docs[9][1]), (103, "école".upper() + " ÉCOLE")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(docs), bench)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()), key=str) == brute_contamination(docs, items)
    kept = decontamination.keep_clean(frame(docs), bench)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in brute_contamination(docs, items) if not r[4]), key=str) and "hash" in kept.columns
    assert decontamination.contamination(frame(docs), bench.limit(0)).filter("n_hit > 0").count() == 0 and decontamination.contamination(frame(docs).limit(0), bench).count() == 0


def shuffled_bytes(spark):
    """Bytes that all stages of this session have written for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_large_benchmarks_move_no_words_with_windows(spark, frame):
    """Without a broadcast the results are the same, and a text of very many words costs in proportion to its length."""
    random.seed(11)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(random.choices(words, k=random.choice([4, 13, 30])))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def text(n):
        w = random.choices(words, k=n)
        for at in (5, n // 2, n - 40):
            w[at:at] = random.choice(items)[1].split()
        return " ".join(w)

    docs = [(i, text(200)) for i in range(30)] + [(99, "plain words only")]
    rows = lambda **kw: sorted(map(repr, contamination_rows(frame(docs), bench, **kw)))
    assert rows(broadcast_bytes=0) == rows()
    written = []
    for n in (50_000, 200_000):
        long = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        before = shuffled_bytes(spark)
        assert decontamination.contamination(long, bench, broadcast_bytes=0).first()["n_hit"] > 0
        written.append(shuffled_bytes(spark) - before)
    assert 0 < written[1] < 6 * written[0] and written[1] < 60_000_000


def contamination_rows(docs, bench, **kw):
    return decontamination.contamination(docs, bench, **kw).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()


def test_toxicity_learns_terms_and_scores_all_rows(spark, frame):
    random.seed(6)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        w = random.choices(plain, k=40)
        if i % 5 == 0:
            w[random.randrange(40)] = random.choice(["Nasty!", "vilely", "horrid"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs += [(1000, None), (1001, ""), (1002, "x" * 5000), (1003, "so nasty"), (1003, "so nasty")]
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame(docs), marks.filter(~toxicity.held_out()))
    got = toxicity.score(frame(docs), model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[i] == t for i, t in labels) and by[1003] == 1 and by[1000] == by[1001] == by[1002] == 0
    toxic = dict(labels)
    for r in got:  # evidence is the nearest examples, with their labels
        found = [(e["doc_id"], e["toxic"], e["cosine"]) for e in r["evidence"]]
        assert len(found) <= 5 and [c for _, _, c in found] == sorted((c for _, _, c in found), reverse=True) and all(toxic[d] == t and 0 < c <= 1 for d, t, c in found)
        assert not r["predicted"] or any(t for _, t, _ in found)
    index = toxicity.BlockMaxIndex(model)
    for _ in range(40):  # block-max search finds just the neighbours that a full scan finds
        vector = tuple(sorted((t, random.randint(1, 3)) for t in random.sample(list(model.idf), min(2, len(model.idf)))))
        dims, w = index.weigh(vector)
        entries = [v for v in model.vectors if v[0]]
        full = np.array([sum(x * dict(zip(*[y.tolist() for y in index.weigh(v[0])])).get(d, 0) for d, x in zip(dims.tolist(), w.tolist())) for v in entries])
        e, c = index.nearest(vector)
        assert np.allclose(full[e], c)
        if len(e):
            assert set(np.flatnonzero((full > 0) & (full > c.min() + 1e-9))) <= set(e.tolist())
    kept = toxicity.keep_clean(frame(docs), model)
    assert kept.count() == sum(r["predicted"] == 0 for r in got) and kept.columns == frame(docs).columns
    assert toxicity.score(frame(docs), toxicity.fit(frame(docs), marks.limit(0))).count() == len(docs)


def brute_scores(texts, labelled, params=toxicity.ToxicityParams()):
    """Scores from texts, by a full scan of all examples in plain Python."""
    counts = lambda t: collections.Counter(toxicity.terms_of(t or ""))
    examples = [(counts(t), y) for t, y in labelled]
    n, base = collections.Counter(t for c, _ in examples for t in c), toxicity.base_rate(sum(y for _, y in labelled), len(labelled))
    pos = collections.Counter(t for c, y in examples if y for t in c)
    weight = {t: (math.log((1 + len(labelled)) / (1 + k)) + 1) * (1 + max(0, (pos[t] - k * base) / math.sqrt(k * base * (1 - base))) ** 2) for t, k in n.items()}

    def unit(c):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors, out = [(unit(c), y) for c, y in examples], []
    for t in texts:
        q = unit(counts(t))
        near = sorted(((sum(x * v.get(k, 0) for k, x in q.items()), y) for v, y in vectors), reverse=True)
        reach = near[params.neighbours - 1][0] if len(near) >= params.neighbours else 0
        near = [(c, y) for c, y in near if c > 0 and c >= reach - 1e-9]
        w = [c / (params.softness + 1 - min(c, 1)) * params.softness for c, _ in near]
        none = [y for c, y in examples if not c]
        if q:
            out.append((sum(x for x, (_, y) in zip(w, near) if y) + params.prior_weight * base) / (sum(w) + params.prior_weight))
        else:
            out.append((sum(none) + params.prior_weight * base) / (len(none) + params.prior_weight))
    return out


def test_toxicity_scores_equal_brute_force(spark, frame):
    random.seed(12)
    words = [f"word{i}" for i in range(60)] + ["nastily", "nastiest", "nastier"]
    docs = [(i, " ".join(random.choices(words[: 60 + 3 * (i % 4 == 0)], k=random.randint(1, 14)))) for i in range(150)] + [(150, ""), (151, None), (152, "!?")]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 153, 2)]
    model = toxicity.fit(frame(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = dict(docs)
    want = brute_scores([t for _, t in docs], [(texts[i], y) for i, y in labels])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(docs), model).collect()}
    assert max(abs(got[i] - w) for (i, _), w in zip(docs, want)) < 1e-9


def test_toxicity_on_held_out_labels(spark):
    """Area under the curve and error of the scores in ten bins, on labels that were not learnt."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    rows = [tuple(r) for r in toxicity.score(docs, model).join(labels.filter(toxicity.held_out()), "doc_id").select("score", "toxic").collect()]
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    area = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    bins = collections.defaultdict(list)
    for s, y in rows:
        bins[min(9, int(s * 10))].append((s, y))
    error = sum(abs(sum(s for s, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(rows)
    assert area > 0.95 and error < 0.15 and not any(s >= 0.3 for s in neg)


def test_toxicity_of_rare_and_mixed_words(spark, frame):
    """Eight toxic examples whose words are in three of them at most: each has neighbours, and scores differ."""
    random.seed(4)
    plain, rare = [f"plain{i}" for i in range(80)], ["grim", "foul", "crass", "snide"]
    docs = [(i, " ".join([*random.choices(plain, k=12), *([rare[i % 4], rare[i % 4 + 1 - 2 * (i % 4 == 3)]] if i < 8 else [])])) for i in range(64)]
    model = toxicity.fit(frame(docs), spark.createDataFrame([(i, int(i < 8)) for i in range(64)], "doc_id long, toxic int"))
    assert {w for _, t in docs for w in t.split()} <= set(model.idf) and min(model.idf.values()) > 0
    asked = [(100 + k, f"{w} {random.choice(plain)}") for k, w in enumerate(rare)] + [(200, " ".join(plain[:10]))]
    got = {r["doc_id"]: r for r in toxicity.score(frame(asked), model).collect()}
    assert all(got[100 + k]["score"] > got[200]["score"] + 0.05 for k in range(4)) and got[200]["predicted"] == 0


def test_term_counter_takes_texts_of_more_pieces_than_it_remembers(spark, frame):
    docs = [(i, f"common word{i} " + ("vile" if i % 3 == 0 else "kind")) for i in range(60)]
    model = toxicity.fit(frame(docs), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    small, text = toxicity.TermCounter(model.idf, most=5), " ".join(f"word{i}" for i in range(200)) + " vile vile"
    for t in (text, "vile kind", text, ""):
        assert repr(small(t)) == repr(toxicity.TermCounter(model.idf)(t))
        counted = collections.Counter(x for x in toxicity.terms_of(t) if x in model.idf)
        assert {model.idf.names[d].as_py(): n for d, n in zip(*(x.tolist() for x in small(t)))} == counted
    assert [v[0].size for v in small.vectors(pa.array([None, "vile", ""]))] == [0, 1, 0] and small.vectors(pa.array([], pa.string())) == []


def brute_licences(text, templates, least=0.8):
    """Every stretch of the text against every notice, by the words themselves."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+(?:[.\-][0-9a-z\x80-\xff]+)*", (t or "").encode().lower())
    pairs = lambda t: list(zip(words(t), words(t)[1:]))
    own, found = pairs(text), []
    for i, (name, notice) in enumerate((n, x) for n, notices in templates.items() for x in notices):
        wanted, span = set(pairs(notice)), max(len(pairs(notice)), len(pairs(notice)) * 5 // 4)
        for s in range(len(own)):
            if own[s] in wanted:
                at = [k for k in range(s, min(len(own), s + span)) if own[k] in wanted]
                share = len({own[k] for k in at}) / len(wanted)
                if share >= least:
                    found.append((-share, -len(wanted), i, at[0], at[-1], name))
    kept, best = [], {}
    for share, _, _, first, last, name in sorted(found):
        if all(last < a or first > z for a, z in kept):
            kept.append((first, last))
            best.setdefault(name, -share)
    return sorted(best.items())


def edited_notices():
    random.seed(21)
    rows, noise = [], [f"n{i}" for i in range(500)]
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for rate in (0, 0.02, 0.05, 0.08):
                w = notice.split()
                for _ in range(round(rate * len(w))):
                    k = random.randrange(len(w))
                    w[k : k + random.randint(0, 1)] = random.choices(noise, k=random.randint(0, 2))
                rows.append((name, " ".join([*random.choices(noise, k=random.randint(0, 90)), *w, *random.choices(noise, k=random.randint(0, 90))])))
    return rows


def test_licences_equal_brute_force_on_edited_notices(frame):
    rows = edited_notices()
    texts = [t for _, t in rows] + [f"{a} {b}" for (_, a), (_, b) in zip(rows[::7], rows[3::7])] + [None, "", "mit", "licensed under the"]
    got = {r["doc_id"]: [(n, round(s, 9)) for n, s in zip(r["licenses"], r["shares"])] for r in licenses.scan_licenses(frame(list(enumerate(texts)))).collect()}
    want = {i: [(n, round(s, 9)) for n, s in brute_licences(t, licenses.TEMPLATES)] for i, t in enumerate(texts)}
    assert got == want and sum(len(x) for x in want.values()) > 140
    whole = [i for i, (name, _) in enumerate(rows) if i % 4 == 0]
    assert all([n for n, _ in got[i]] == [rows[i][0]] and got[i][0][1] == 1 for i in whole)  # a whole notice is its own license and no neighbour's


def test_licences_of_several_notices_equal_brute_force_in_any_company():
    """Adjacent and edited notices, among other texts: equal to brute force, and the same whatever stands around."""
    rng, noise = random.Random(7), [f"n{i}" for i in range(300)]
    notices = [n for x in licenses.TEMPLATES.values() for n in x]
    texts = []
    for _ in range(300):
        words = []
        for notice in rng.sample(notices, rng.choice([1, 2, 2, 3, 4])):
            w = notice.split()
            for _ in range(rng.randint(0, len(w) // 22)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choices(noise, k=rng.randint(0, 2))
            words += [*w, *rng.choices(noise, k=rng.randint(0, 12))]
        texts.append(" ".join(words))
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, 0.8)
    rounded = lambda found: [[(n, round(s, 9)) for n, s, _ in x] for x in found]
    want = [[(n, round(s, 9)) for n, s in brute_licences(t, licenses.TEMPLATES)] for t in texts]
    assert rounded(scanner.scan(texts)) == want
    alone = [scanner.scan([t])[0] for t in texts]
    for k in range(10):
        company = [x for t in texts[:60] for x in (" ".join(rng.choices(noise, k=rng.randint(0, 40 * k))), t)]
        assert scanner.scan(company)[1::2] == alone[:60]


def test_licences(frame):
    mit = " ".join(licenses.TEMPLATES["MIT"][1].split())
    rows = [(1, "a b c " * 50 + "\nReleased under the MIT License.\n" + "d e " * 300), (2, "x " * 500 + mit.upper().replace("CHARGE", "FEE") + " y" * 90), (3, "Licensed under a roof"), (4, None), (5, ""), (6, "licensed"), (7, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (7, "MIT"), (8, "w" * 9000)]
    rows += [(9, "This work is licensed under the GNU General Public License, version 2."), (10, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"), (11, "v " * 400_000 + "Released under the MIT License." + " v" * 400_000), (None, "Released under the ISC License.")]
    got = sorted(((r["doc_id"] or 0, tuple(r["licenses"])) for r in licenses.scan_licenses(frame(rows)).collect()))
    assert got == [(0, ("ISC",)), (1, ("MIT",)), (2, ("MIT",)), (3, ()), (4, ()), (5, ()), (6, ()), (7, ()), (7, ("Apache-2.0", "CC-BY-NC-4.0")), (8, ()), (9, ("GPL-2.0",)), (10, ("CC-BY-NC-4.0",)), (11, ("MIT",))]
    assert licenses.scan_licenses(frame(rows).limit(0)).count() == 0 and licenses.bands_for(0.25) >= 32 - 1


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(rows[i][0]), find(rows[j][0])
                    parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), (None if d is None else find(d)) if s else d) for (d, _), s in zip(rows, sets)), key=str)


def near_rows():
    random.seed(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        t = [random.choice(words) for _ in range(random.choice([0, 1, 3, 5, 8, 30, 120]))]
        rows.append(t)
        for _ in range(random.randint(0, 5)):
            u = list(t)
            for _ in range(random.randint(0, max(1, len(t) // 25))):
                if u:
                    u[random.randrange(len(u))] = random.choice(words)
            rows.append(u)
    rows = [(i, random.choice([" ", "  ", "\n"]).join(t)) for i, t in enumerate(rows)]
    return [*rows, (900, None), (901, ""), (902, " \n "), (903, rows[3][1]), (904, rows[3][1].upper()), (None, rows[3][1]), (3, rows[3][1])]


def test_components_equal_brute_force(frame):
    rows = near_rows()
    for n, percent, chunk in ((4, 85, 600), (5, 80, 3)):
        got = sorted(map(tuple, ngram_join.near_duplicates(frame(rows), n, percent, chunk).collect()), key=str)
        assert got == brute_components(rows, n, percent)
    kept = [r["doc_id"] for r in ngram_join.one_of_each(frame(rows)).collect()]
    want = [d for d, _, c in brute_components(rows, 5, 80) if d == c or d is None]
    assert sorted(map(str, kept)) == sorted(map(str, dict.fromkeys(want)))
    assert ngram_join.near_duplicates(frame(rows).limit(0)).count() == 0


def test_prefix_tree_reads_no_runs_of_closed_subtrees():
    random.seed(11)
    groups = [random.sample(range(100 * g, 100 * g + 100), 60) for g in range(20)]
    sets = [np.array(sorted(random.sample(g, random.randint(40, 60))), np.int64) for g in groups for _ in range(10)]
    tree = ngram_join.PrefixTree(sets, 2000)
    for query in sets[:40]:
        want = [i for i in range(len(sets)) if (k := len(set(query.tolist()) & set(sets[tree.order[i]].tolist()))) * 100 >= 70 * (query.size + sets[tree.order[i]].size - k)]
        assert tree.linked(query, 70).tolist() == want
    everything = sum(s.size for s in sets)
    tree.read = 0
    assert tree.linked(np.arange(5), 70).size == 0 and tree.read == 0  # too short for any set: nothing is read
    tree.linked(sets[0], 70)
    assert 0 < tree.read < everything
    tree.read = 0
    for i in range(len(sets)):
        tree.take(i)
    assert tree.linked(sets[0], 70).size == 0 and tree.read == 0


def test_links_of_ids_with_texts_of_unlike_size(frame):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("own", 104)), (1, words("both", 14)), (2, words("both", 14) + " end"), (3, words("far", 30))]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(frame(rows), 5, 80).collect())
    assert got == sorted((d, c) for d, _, c in brute_components(rows, 5, 80))


def test_sizes_and_links_of_texts_of_null_and_repeated_ids(frame):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("own", 104)), (1, words("both", 14)), (2, words("both", 14) + " end"), (None, words("null", 9)), (None, words("null", 9)), (None, ""), (3, words("far", 30)), (4, words("far", 30)), (4, words("near", 200)), (5, words("near", 190)), (4, ""), (6, "")]
    assert sorted(map(tuple, ngram_join.near_duplicates(frame(rows), 5, 80).collect()), key=str) == brute_components(rows, 5, 80)


def brute_cut(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    c = collections.Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    out = []
    for d, b in data:
        m = bytearray(len(b))
        for i in range(len(b) - 199):
            if c[b[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, m) if not y)
        out.append((d, len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut_rows():
    random.seed(5)
    words = ["".join(random.choice("abcdeé ") for _ in range(random.randint(2, 9))) for _ in range(2000)]
    para = lambda n: " ".join(random.choice(words) for _ in range(n))
    shared = [para(random.randint(25, 80)) for _ in range(8)]
    rows = [(i, " ".join(random.choice([para(random.randint(1, 50)), random.choice(shared), random.choice(shared)[random.randint(0, 80) :], para(3)]) for _ in range(random.randint(0, 5)))) for i in range(60)]
    base = para(150)
    rows += [(300 + i, base[: 20 * i] + f"ZZ{i}" + base[20 * i + 3 :]) for i in range(45)]
    rows += nul_rows()
    return [*rows, (500, None), (501, ""), (502, "a" * 1500), (503, rows[3][1]), (3, rows[3][1]), (504, "ab" * 400), (505, shared[0] * 3), (None, rows[7][1]), (506, shared[1][:200]), (507, shared[1][:199])]


def nul_rows():
    """Texts that end, or begin, where others go on with NULs: an end is no NUL."""
    letters = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    rows = []
    for g in range(8):
        common = letters(185)
        texts = [letters(300) + common + tail for tail in ("\0" * 20, "", "\0" * 20)] + ["\0" * 20 + common[::-1] + letters(60), common[::-1] + letters(60), "\0" * 20 + common[::-1] + letters(60), common[:170] + "\0" * 40]
        random.shuffle(texts)
        rows += [(600 + 10 * g + i, t) for i, t in enumerate(texts)]
    return rows


def test_removed_bytes_equal_brute_force(frame):
    rows = cut_rows()
    for most_members, most_rows in ((50_000, 10_000), (5, 10_000), (50_000, 2)):
        assert sorted(map(tuple, suffix_dedup.remove_repeats(frame(rows), most_members, most_rows).collect()), key=str) == brute_cut(rows)
    random.shuffle(rows)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(frame(rows)).collect()), key=str) == brute_cut(rows)
    left = suffix_dedup.cut_texts(frame(rows))
    assert left.columns == frame(rows).columns and left.count() == sum(n > removed or n == 0 for _, n, removed, _, _ in brute_cut(rows))
    assert suffix_dedup.remove_repeats(frame(rows).limit(0)).count() == 0


def test_classes_over_small_batches():
    random.seed(9)
    made = ((random.randrange(6), random.randrange(2), random.randrange(2), random.randrange(3), random.randrange(2), random.randrange(4) * 300 + 200, 200) for _ in range(300))
    rows = sorted((a, random.randrange(1, 4) if a > 3 else 0, *rest) for a, *rest in made)  # anchors above 3 are dealt to parts
    names, kinds = ["anchor", "part", "near1", "near2", "k1", "k2", "at", "room"], [*[pa.int64()] * 6, pa.int32(), pa.int16()]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=names)
    for size in (1, 2, 7, 300):
        out = [r for b in suffix_dedup._classes([batch(rows[i : i + size]) for i in range(0, 300, size)]) for r in b.to_pylist()]
        spans = {(r["k1"], r["k2"], r["at"], r["stop"]) for r in out if r["stop"] >= 0}
        stand = {(r["anchor"], r["k1"], r["k2"], r["at"]) for r in out if r["stop"] == -1}
        one_each = {(r["anchor"], r["near1"], r["near2"], r["k1"], r["k2"], r["at"]) for r in out if r["stop"] == -2}
        groups = collections.defaultdict(lambda: collections.defaultdict(set))
        for a, p, c, d, *k, at, _ in rows:
            groups[a, p][c, d].add((*k, at))
        assert spans == {(*k, at - suffix_dedup.LEFT, at + 200) for g in groups.values() for m in g.values() if len(m) > 1 for *k, at in m}
        for (a, p), g in groups.items():
            for near, m in g.items():
                if p:
                    assert any((a, *near, *place) in one_each for place in m)
                else:
                    assert len(g) < 2 or any((a, *place) in stand for place in m)


def test_reach_of_texts_that_end_before_nuls():
    for order in ((0, 1, 2), (1, 0, 2), (0, 2, 1)):
        rights = [[b"A" * 32 + b"\0" * 20, b"A" * 32, b"A" * 32 + b"\0" * 20][i] for i in order]
        right = np.frombuffer(b"".join(x.ljust(200, b"\0") for x in rights), np.uint8).reshape(3, 200)
        left = np.frombuffer(b"".join((b"B" * 150 + bytes([i])).ljust(168, b"\0") for i in range(3)), np.uint8).reshape(3, 168)
        got = suffix_sort.shared_reach(right, np.array([len(x) for x in rights]), left, np.full(3, 151), np.zeros(3, np.int64), 200)
        assert [tuple(x) for x in zip(*(y.tolist() for y in got))] == [(52, 150, True) if i != 1 else (0, 0, False) for i in order]


def test_deep_shallow_order_and_reach():
    random.seed(7)
    for _ in range(30):
        n = random.randint(1, 120)
        group = np.sort(np.array([random.randrange(4) for _ in range(n)]))
        seeds = [bytes(random.choice(b"ab") for _ in range(200)) for _ in range(3)]
        rows = []
        for _ in range(n):
            s = bytearray(random.choice(seeds))
            for _ in range(random.randrange(3)):
                s[random.randrange(200)] = random.choice(b"abc")
            rows.append(bytes(s))
        m = np.frombuffer(b"".join(rows), np.uint8).reshape(n, 200)
        order = suffix_sort.deep_shallow_order(m, np.full(n, 200), group)
        assert [(group[i], rows[i]) for i in order] == sorted((g, r) for g, r in zip(group, rows))
        left = m[:, ::-1][:, :168].copy()
        got = suffix_sort.shared_reach(m, np.full(n, 200), left, np.full(n, 168), group, 200)
        common = lambda a, b: next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        for i in range(n):
            pairs = [(common(rows[i], rows[j]), common(left[i].tobytes(), left[j].tobytes())) for j in range(n) if j != i and group[i] == group[j]]
            ok = [(r, x) for r, x in pairs if r + x >= 200]
            assert (got[0][i], got[1][i], got[2][i]) == (max((r for r, _ in ok), default=0), max((x for _, x in ok), default=0), bool(ok))


@pytest.mark.parametrize("chunk, many", [(3, 60), (600, 1500)])
def test_chain_of_ids_with_several_texts_is_one_component(frame, chunk, many):
    """Each id links with the next alone, and every second one stands twice, with other white space: no link is lost."""
    words = [f"w{i}" for i in range(8 * many + 103)]
    rows = []
    for i in range(many):
        w = words[8 * i : 8 * i + 103]
        rows.append((i, " ".join(w)))
        if i % 2:
            rows.append((i, "  ".join(w)))
    got = ngram_join.near_duplicates(frame(rows), n=4, percent=85, chunk=chunk).collect()
    assert len(got) == len(rows) and {(r["n_shingles"], r["component_id"]) for r in got} == {(100, 0)}


@pytest.mark.parametrize("chunk", [2, 3, 600])
def test_ids_with_several_near_texts_equal_brute_force(frame, chunk):
    rng, rows = random.Random(chunk), []
    for k in range(6):
        base = [f"a{k}x{j}" for j in range(40)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(40)] = f"new{rng.randrange(9)}"
            for _ in range(rng.choice([1, 1, 2, 3])):
                rows.append((rng.choice([len(rows), len(rows), 5 * k]), rng.choice([" ", "  ", "\n"]).join(w)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(i, []).append({tuple(w[j : j + 4]) for j in range(len(w) - 3)})
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    got = ngram_join.near_duplicates(frame(rows), n=4, percent=80, chunk=chunk).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, root(i)) for i, _ in rows)


def test_very_long_examples_do_not_outgrow_a_model(spark, frame):
    """Examples are taken by hash until their texts hold the bytes that a model may be fitted on; scores go to all rows."""
    docs = [(i, f"plain{i} " * 4 + ("vile" if i % 3 == 0 else "kind")) for i in range(30)] + [(100, "endless vile " * 200_000), (101, "word " * 3000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(100, 1), (101, 0)], "doc_id long, toxic int")
    whole = toxicity.fit(frame(docs), labels)
    bound = toxicity.fit(frame(docs), labels, toxicity.ToxicityParams(example_bytes=10_000))
    small = toxicity.fit(frame(docs), labels, toxicity.ToxicityParams(example_bytes=300))
    assert "endless" in set(whole.idf) and "endless" not in set(bound.idf) and 0 < len(small.idf) < len(bound.idf)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame(docs), bound).collect()}
    assert len(got) == len(docs) and got[0] == got[3] == 1 and got[1] == got[101] == 0
    none = toxicity.fit(frame(docs), labels, toxicity.ToxicityParams(example_bytes=0))
    assert toxicity.score(frame(docs), none).filter("predicted = 1").count() == 0


def test_ngram_join_query_equals_sql(spark):
    tables = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tables}/documents.parquet'")
    want = con.sql(ORACLES["op6_ngram_join"])
    order = [want.columns.index(c) for c in ("doc_id", "n_shingles", "component_id")]
    got = queries.op6_ngram_join(spark, tables).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
