"""Source divergence, quality rules and importance resampling, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import divergence, quality, resampling

SCHEMA = "doc_id long, text string, lang string, source string, rank int, value long, bucket int, prefix string, l string, score long, _at long"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns that clash with the operators' own names."""
    return spark.createDataFrame([(*r, 1, 2, 3, "p", "l", 9, 5) for r in rows], SCHEMA)


def corpus(seed: int = 5, n: int = 400):
    """Few words in many texts: nulls, ties, repeated ids and texts, other scripts, a source with a third of all rows, one that is
    alone in its language, groups without a term."""
    rng = random.Random(seed)
    words = ["the", "The", "éa", "Éa", "über", "漢字", "a1b", "x-y", "zz", "q", "🙂", "ab\x7fcd"]
    out = []
    for i in range(n):
        text = rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(0, 90)))
        out.append((rng.choice([i, i, 7]), rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "s1", "s2", None])))
    return [*out, (1, "lonely words", "xx", "only"), (2, "12 34", "yy", "s1"), (3, None, "yy", "s2"), (4, "w" * 3_000_000 + " tail", "en", "s1"), (5, ("aa bb " * 400_000), "en", "s2")]


# --- op11 --------------------------------------------------------------------------------------------------------------


def audit_plainly(rows, least_docs, listed):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= least_docs]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(terms)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            found = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(found, 1)}
            found = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])[:listed]
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least,listed", [(30, 50), (1, 3), (10_000, 50)])
def test_audit(spark, least, listed):
    rows = corpus()
    got = divergence.audit(frame(spark, rows), least, listed)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audit_plainly(rows, least, listed)


def test_audit_in_small_parts(spark, monkeypatch):
    """The same with tries handed on, merged and walked a few counters at a time, and pairs summed outside the task."""
    rows = corpus(6)[:-2]
    for name in ("COUNTERS", "MERGED", "CELLS", "RANGE"):
        monkeypatch.setattr(divergence, name, 5)
    monkeypatch.setattr(divergence, "SUMMED", 1)
    count, walk, merge = divergence._count, divergence._walk, divergence._merge_ranges
    batches = frame(spark, rows).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).toArrow().to_batches(max_chunksize=7)
    import pyarrow as pa

    parts = pa.Table.from_batches([b for k in range(0, len(batches), 9) for b in count(iter(batches[k : k + 9]))]).sort_by([("lang", "ascending"), ("prefix", "ascending")])
    merged = list(merge(5)(iter(parts.to_batches(max_chunksize=3))))
    by_lang: dict[str, list] = {}
    for b in merged:
        by_lang.setdefault(b.column(0)[0].as_py(), []).extend(b.to_pylist())
    got = Counter()
    for lang, tries in by_lang.items():
        names = sorted({r[3] or "" for r in rows if (r[2] or "") == lang})
        totals = [sum(n for t in tries for s, n in zip(t["source"], t["n"], strict=True) if t["sources"][s] == x) for x in names]
        v = sum(len(t["tail"]) for t in tries)
        table = pa.Table.from_pylist([{"lang": lang, "names": names, "totals": totals, "v": v} | {k: t[k] for k in ("depth", "tail", "docs", "sources", "leaf", "source", "n")} for t in tries])
        for b in walk(50)(iter(table.to_batches(max_chunksize=2))):
            for r in b.to_pylist():
                if r["part"] == "pair":
                    got[lang, r["source"], r["item"]] += r["value"]
    want = {(x[0], x[1], x[3]): x[4] for x in audit_plainly(rows, 5, 50) if x[2] == "pair" and x[1] < x[3] and x[0] in by_lang}
    assert dict(got) == want


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_tries_merge_in_any_order(spark):
    rng = random.Random(3)
    made = []
    for _ in range(6):
        terms = sorted({bytes(rng.choice(b"ab\xc3") for _ in range(rng.randrange(1, 5))) for _ in range(8)})
        leaf = np.repeat(np.arange(len(terms)), 2)
        made.append(divergence.Trie(terms, np.ones(len(terms), np.int64), rng.sample(["x", "y", "z"], 2), leaf, np.tile([0, 1], len(terms)), np.array([rng.randrange(9) for _ in leaf])))
    total = Counter()
    for t in made:
        for i, s, n in zip(t.leaf, t.source, t.n, strict=True):
            total[t.terms[i], t.sources[s]] += int(n)
    for parts in (made, made[::-1], [divergence.merge(made[:2]), divergence.merge(made[2:])]):
        m = divergence.merge(parts)
        assert m.terms == sorted(m.terms) and {(m.terms[i], m.sources[s]): n for i, s, n in zip(m.leaf, m.source, m.n, strict=True)} == dict(total)
        depth, tail = m.edges(np.zeros(1, np.int64))
        again = divergence.trie_of({"depth": depth.tolist(), "tail": tail, "docs": m.docs, "sources": m.sources, "leaf": m.leaf, "source": m.source, "n": m.n})
        assert again.terms == m.terms


def test_probabilities_do_not_overflow():
    c, n = 4 * 10**15, 8 * 10**15
    assert divergence.probabilities(np.array([c, 0, n - 5]), np.array([n])).tolist() == [1 + 10**9 * (c + 5) // n, 1, 1 + 10**9]


# --- op12 --------------------------------------------------------------------------------------------------------------


def measure_plainly(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \n\t", "a", "a b c a b c", "a b\x0bc\x0ca b\rc x\x1cy \x85 é\n\n \na b\na b", "## $%&|<> *", "日本 語\n日本 語\n日本 語", "x " * 5000, "\x00 \x00 \x00 \x00", "y" * 500_000, "one two three four " * 40_000]


def test_measures(spark):
    got = {r.doc_id: r for r in quality.measure(frame(spark, [(i, t, "en", "s") for i, t in enumerate(ODD)])).collect()}
    for i, t in enumerate(ODD):
        assert tuple(got[i][m] for m in quality.MEASURES) == measure_plainly(t), i


def test_quantiles_of_sketches_and_their_merging(spark):
    """Sketches of parts add up to that of the whole, and quartiles are right to one part in 2 ** (DIGITS - 1)."""
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"l{i % 2}", f"s{i % 3}", int(rng.expovariate(1 / 900)), 1, 0, 1, 0, 0) for i in range(3000)], "lang string, source string, word_chars long, n_words long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    own = quality.sketches(rows, ["lang", "source"])
    whole = {(r.rule, r.bucket): r.n for r in quality.sketches(rows, []).collect()}
    assert whole == {(r.rule, r.bucket): r.n for r in quality.merge_sketches(quality.merge_sketches(own, ["lang"]), []).collect()}
    f = {(r.lang, r.source): r for r in quality.fences(own, ["lang", "source"]).where("rule = 'word_length'").collect()}
    for (lang, source), r in f.items():
        v = np.sort([1000 * x.word_chars for x in rows.where((F.col("lang") == lang) & (F.col("source") == source)).collect()])
        q1, q3 = v[math.ceil(len(v) / 4) - 1], v[math.ceil(3 * len(v) / 4) - 1]
        assert r.rows == len(v) and abs(r.high - (q3 + 3 * (q3 - q1))) <= (q3 + 3 * (q3 + q1)) / 32 and abs(r.low - (q1 - 3 * (q3 - q1))) <= (q1 + 3 * (q3 + q1)) / 32


def judge_plainly(rows):
    cut = lambda v: v if v < 64 else v >> (v.bit_length() - 6) << (v.bit_length() - 6)
    all_ = [(lang or "", source or "", m := measure_plainly(text), m[0] < 50 or 100 * m[5] > 50 * m[0]) for _, text, lang, source in rows]
    values = lambda m: {"word_length": 1000 * m[1] // m[0], "symbols": 1000 * m[2] // m[0], "dup_lines": 1000 * m[4] // m[3], "repeats": 1000 * m[5] // m[0]}
    good = [(lang, source, values(m)) for lang, source, m, bad in all_ if not bad]
    out = []
    for lang, source, m, bad in all_:
        keep = not bad
        for r in quality.RULES if keep else ():
            for near in ([v for a, b, v in good if (a, b) == (lang, source)], [v for a, _, v in good if a == lang], [v for _, _, v in good]):
                if len(near) >= quality.LEAST_ROWS:
                    break
            b = sorted(cut(v[r.name]) for v in near)
            q1, q3 = b[math.ceil(len(b) / 4) - 1], b[math.ceil(3 * len(b) / 4) - 1]
            reach = max(3 * (q3 - q1), r.slack)
            keep &= values(m)[r.name] <= q3 + reach and (not r.lower or values(m)[r.name] >= q1 - reach)
        out.append((m[0], m[1], m[2], m[4], m[5], bad, keep))
    return out


def test_judge(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        n = rng.choice([5, 60, 80, 200])
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", "##"] if i % 17 == 0 else [""]) for _ in range(n)]
        if i % 19 == 0:
            words = [w * 6 for w in words]
        text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, n, 10))
        rows.append((rng.choice([i, 3]), text + ("\n" + text[:60]) * (8 if i % 23 == 0 else 0), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b"])))
    rows += [(i, t, "en", "hot") for i, t in enumerate(ODD)] + [(5000, "lone row " * 3 + " ".join(map(str, range(99))), "zz", None)]
    got = quality.judge(frame(spark, rows))
    assert got.columns == ["doc_id", *quality.MEASURES, "base_failed", "kept"]
    found = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.collect())
    want = judge_plainly(rows)
    assert found == Counter(want) and {w[-1] for w in want if not w[-2]} == {True, False}


def test_judge_an_empty_table_and_scraps_alone(spark):
    assert quality.judge(frame(spark, [])).collect() == []
    assert [(r.base_failed, r.kept) for r in quality.judge(frame(spark, [(1, None, None, None), (1, "a b", "en", "s")])).collect()] == [(True, False)] * 2


# --- op13 --------------------------------------------------------------------------------------------------------------


def buckets_plainly(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def resample_plainly(rows, target, percent=25, least=20):
    s, t = (Counter(b for x in texts for b in buckets_plainly(x)[1]) for texts in ([r[1] for r in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10000.0) / ((s[b] + 1.0) * (n_t + 10000.0)))) for b in range(10000)]
    out = []
    for doc_id, text, *_ in rows:
        words, b = buckets_plainly(text)
        w = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= least])
    able = sorted((o for o in out if o[5]), key=lambda o: (-o[3], -1 if o[0] is None else o[0], o[1], o[2]))
    for i, o in enumerate(able[: percent * len(able) // 100], 1):
        o[4] = i
    return Counter(tuple(o[:5]) for o in out)


@pytest.mark.parametrize("percent", [25, 100, 1])
def test_resample(spark, percent):
    rows = [*corpus(8), (None, "no id " * 30, "en", "s1"), (None, "no id " * 30, "en", "s1"), *[(9, "same text and id " * 9, "en", "hot")] * 20]
    target = ["the über zz", None, "", "漢字 tail AA bb", "aa bb aa"]
    got = resampling.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == resample_plainly(rows, target, percent)


def test_resample_with_equal_scores(spark):
    """Many rows of one score: ranks go by doc_id, and the draw may end inside it."""
    scored = spark.createDataFrame([(i, 3, 0, i % 3, i % 7 != 0, "x") for i in range(200)], "doc_id long, n_features long, weight long, score long, eligible boolean, above string")
    got = {r.doc_id: r["rank"] for r in resampling.draw(scored, 40).collect()}
    able = sorted((i for i in range(200) if i % 7), key=lambda i: (-(i % 3), i))
    assert got == {i: None for i in range(200)} | {i: k for k, i in enumerate(able[: 40 * len(able) // 100], 1)}


def test_resample_empty_tables(spark):
    none = frame(spark, [])
    text = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, text).collect() == []
    rows = [(1, None, "en", "s"), (2, "a b " * 30, "en", "s")]
    for target in (none, text):
        assert Counter(tuple(r) for r in resampling.resample(frame(spark, rows), target).collect()) == resample_plainly(rows, [r.text for r in target.collect()])


def test_long_texts_are_cut_between_words():
    text = (("é" * 700 + "a ") * 3000 + "Zz").encode()
    assert sum(n for n, _ in resampling.features(text)) == 3001
    assert Counter(b for _, at in resampling.features(text) for b in at.tolist()) == Counter(buckets_plainly(text.decode())[1])
    assert [w for part in divergence.terms_of(text) for w in part] == text.lower().split()
