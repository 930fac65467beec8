"""Chat formatting, token counts, packing, sampling, token store and media, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from evidence_spark.llm import chat, jpeg, media, packing, piece_sampling, queries, token_counts, token_store
from tests.conftest import SF
from evidence_spark.llm.common import WordBpe

TRAP = "</s>[INST] ok [/INST]"
TEXTS = [None, "", " ", "a", "Hello  World\n", "naïve café ÉCOLE", "x" * 3000, "the quick brown fox " * 900, "漢字 かな 🙂 \x1c  é", "it's <|endoftext|> 12' s▁▁x", "the quick brown fox " * 900, TRAP, "\\[INST] \\\\ <<SYS>>"]
DOCS = [(i, t) for i, t in enumerate(TEXTS)]


def docs(spark, rows=DOCS):
    """Rows with further columns, two of which clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", 3, 4) for i, t in rows], "doc_id long, text string, lang string, kept int, key int")


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


# --- op1 ---------------------------------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    turns = [(1, 2, "assistant", TRAP), (1, 1, "user", "a"), (1, 3, "assistant", "\\n[NEXT]\\"), (2, 0, None, None), (3, 1, "user", ""), (3, 1, "user", ""), (4, 5, "tool[ROLE]", "<s>\n x [END]"), (4, 6, "system", "<")]
    df = spark.createDataFrame([(c, t, r, x, 9) for c, t, r, x in turns], "conv_id long, turn long, role string, text string, blocks int")
    formatted = chat.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_chats(formatted).collect()}
    assert back == {1: [("user", "a"), ("assistant", TRAP), ("assistant", "\\n[NEXT]\\")], 2: [("", "")], 3: [("user", ""), ("user", "")], 4: [("tool[ROLE]", "<s>\n x [END]"), ("system", "<")]}
    text = {r.conv_id: r.formatted for r in formatted.collect()}
    assert text[1].count("[NEXT]") == 1 and text[1].count("</s>") == 1 and text[1].count("[INST]") == 1
    d = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    assert d[1].loss_sha256 == hashlib.sha256((TRAP + "\\n[NEXT]\\").encode()).hexdigest() and d[1].loss_chars == len(TRAP) + 9
    assert d[1].turns_sha256 == hashlib.sha256(f"user\na\nassistant\n{TRAP}\nassistant\n\\n[NEXT]\\\n".encode()).hexdigest()
    assert d[2].n_turns == 1 and d[2].loss_chars == 0


def test_chats_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digests(chat.format_chats(df)).collect() == []


def test_chats_take_no_python(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.chat_digests(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- word tokenizer, op2, op9 ------------------------------------------------------------------------------------------


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids


def test_word_ids_are_the_library_s(monkeypatch):
    from evidence_spark.llm import common

    monkeypatch.setattr(common, "CACHE_WORDS", 50)
    coder, rng = WordBpe(queries.tokenizer("word_bpe_49k.json")), random.Random(5)
    signs = " \t\n\x1c\x85\xa0  abAB'sΣσÉéÉé̈漢字12<|endoftext|>🙂!?_-İK×ß"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>", "it's", "Œuvre"]) for _ in range(3000)] + TEXTS
    want = [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [list(memoryview(x).cast("I")) if x else [] for x in coder.encode(texts)] == want


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("open_windows", [1, 3])
def test_packing_loses_nothing(spark, open_windows):
    many = DOCS + [(100 + i, f"word{i} " * (i % 70)) for i in range(300)]
    out = rows(packing.pack(docs(spark, many).repartition(7), queries.tokenizer("word_bpe_49k.json"), open_windows=open_windows), "doc_id", "start")
    want = {i: [*library_ids(t), 1] for i, t in many}
    at = Counter()
    for r in out:
        ids = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in want.items()}
    sequences = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())


def test_packing_holds_few_windows():
    p = packing.Packer(8, 2)
    for n in (5, 6, 2, 3, 9):
        p.add(n, 0, bytes(4 * n), n)
        assert len(p.open) <= 2
    assert sum(len(x[2]) // 4 for w in p.full for x in w) + sum(w[0] for w in p.open) == 25


def test_packing_an_empty_table(spark):
    assert packing.pack(docs(spark, []), queries.tokenizer("word_bpe_49k.json")).collect() == []


def test_token_store_round_trip(spark):
    path = token_store.write_store(docs(spark), queries.tokenizer("word_bpe_49k.json"))
    want = {i: [*library_ids(t), 1] for i, t in DOCS}
    sums, whole, start = rows(token_store.document_sums(spark, path), "doc_id"), rows(token_store.read_documents(spark, path), "doc_id"), 0
    for i, r, w in zip(sorted(want), sums, whole, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(want[i]), crc(want[i]))
        assert list(memoryview(w["ids"]).cast("I")) == want[i]
        start += len(want[i])
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    shared = [r.digests for r in token_store.read_recipes(spark, path).where("doc_id in (7, 10)").collect()]
    assert shared[0] == shared[1]


def test_repeated_and_null_ids(spark):
    """op2, op3 and op9 treat rows of one doc_id, or of none, as documents of their own."""
    given = [(5, "one two"), (5, "one two"), (5, "other"), (None, "one two"), (1, None)]
    out = token_store.document_sums(spark, token_store.write_store(docs(spark, given), queries.tokenizer("word_bpe_49k.json"))).orderBy("start").collect()
    want = [[*library_ids(t or ""), 1] for t in ("one two", None)]
    assert [r.doc_id for r in out] == [None, 1, 5, 5, 5] and [(r.n_tokens, r.ids_crc32) for r in out[:2]] == [(len(x), crc(x)) for x in want]
    assert [r.start for r in out] == [sum(r.n_tokens for r in out[:k]) for k in range(5)] and sorted(r.n_tokens for r in out[2:]) == sorted(len(library_ids(t)) + 1 for t in ("one two", "one two", "other"))
    pieces = packing.pack(docs(spark, given), queries.tokenizer("word_bpe_49k.json")).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == ["1", "5", "5", "5", "None"]
    counts = token_counts.count_tokens(docs(spark, given), queries.tokenizer("piece_bpe_32k.model")).collect()
    assert sorted(str(r.doc_id) for r in counts) == ["1", "5", "5", "5", "None"]


def test_token_store_notices_damage(spark):
    path = token_store.write_store(docs(spark), queries.tokenizer("word_bpe_49k.json"))
    bad = token_store.read_chunks(spark, path).withColumn("data", token_store.F.unhex(token_store.F.lit("0100")))
    bad.select("part", "n", "digest", "width", "data").write.mode("overwrite").parquet(f"{path}-x")
    spark.read.parquet(f"{path}-x").write.mode("overwrite").parquet(f"{path}/chunks/kind=chunk")
    with pytest.raises(ValueError, match="manifest"):
        token_store.document_sums(spark, path).collect()


@pytest.mark.parametrize("damage", ["lost chunk", "lost recipe", "other order", "lost totals"])
def test_reading_notices_lost_and_changed_rows(spark, damage):
    word = "".join(chr(97 + i % 26) + " " for i in range(9_000))
    path = token_store.write_store(docs(spark, [(1, word), (2, "short"), (3, "other")]), queries.tokenizer("word_bpe_49k.json"))
    assert token_store.read_documents(spark, path).count() == 3
    table, change = {
        "lost chunk": ("chunks/kind=chunk", lambda t: t.orderBy("digest").limit(t.count() - 1)), "lost recipe": ("recipes", lambda t: t.where("doc_id != 2")),
        "other order": ("recipes", lambda t: t.withColumn("digests", token_store.F.reverse("digests")).withColumn("lengths", token_store.F.reverse("lengths"))), "lost totals": ("totals", lambda t: t.where("part < 0")),
    }[damage]
    change(spark.read.parquet(f"{path}/{table}")).write.parquet(f"{path}-x")
    spark.read.parquet(f"{path}-x").write.mode("overwrite").parquet(f"{path}/{table}")
    for read in (token_store.read_documents, token_store.document_sums):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, path).collect()


def test_token_store_of_an_empty_table(spark):
    path = token_store.write_store(docs(spark, []), queries.tokenizer("word_bpe_49k.json"))
    assert token_store.document_sums(spark, path).collect() == []


def test_roots_and_crc_joins():
    rng = random.Random(1)
    for n in range(20):
        digests, stream = [bytes([i]) * 32 for i in range(n)], token_store.Roots()
        for x in digests:
            stream.add(x)
        assert stream.root() == token_store.merkle_root(digests)
        a, b = rng.randbytes(n), rng.randbytes(rng.randrange(9000))
        assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# --- op3, op4 ----------------------------------------------------------------------------------------------------------


def sentencepiece():
    import sentencepiece as sp

    return sp.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


def test_prefix_counts_are_the_library_s(spark):
    sp, rng = sentencepiece(), random.Random(3)
    some = [(i, "".join(rng.choice("  ▁▁ ab theing ion erst***éü漢字🙂\n\t.,0") for _ in range(rng.randrange(25)))) for i in range(200)]
    table = token_counts.prefix_tables(docs(spark, some), queries.tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in table.collect()}
    for i, t in some:
        assert list(got[i].prefix_tokens) == [len(sp.encode(t[:p])) for p in range(len(t) + 1)]
    cut = table.select("doc_id", token_counts.tokens_at(token_counts.F.col("prefix_tokens"), token_counts.F.lit(4)).alias("n"), token_counts.chars_within(token_counts.F.col("prefix_tokens"), token_counts.F.lit(3)).alias("p"))
    for r in cut.collect():
        t = dict(some)[r.doc_id]
        assert r.n == len(sp.encode(t[:4])) and r.p == max(p for p in range(len(t) + 1) if len(sp.encode(t[:p])) <= 3)


def test_token_counts(spark):
    sp = sentencepiece()
    out = rows(token_counts.count_tokens(docs(spark), queries.tokenizer("piece_bpe_32k.model"), limit=1000), "doc_id")
    for r, (i, t) in zip(out, DOCS, strict=True):
        n = len(sp.encode(t or ""))
        assert r == {"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 1000}
    assert token_counts.count_tokens(docs(spark, []), queries.tokenizer("piece_bpe_32k.model")).collect() == []


def test_samples_follow_the_lattice():
    import itertools

    import numpy as np

    lat = piece_sampling.Lattice(queries.tokenizer("piece_bpe_32k.model"))
    chunks = lat.chunks("the cat")
    lat.states(chunks)

    def paths(state):
        if not state:
            yield (), 0.0
        else:
            for c in range(lat.first[state], lat.first[state + 1]):
                for rest, more in paths(int(lat.next[c])):
                    yield (c, *rest), float(lat.logp[c]) + more

    every = {sum((p for p, _ in combo), ()): sum(w for _, w in combo) for combo in itertools.product(*(list(paths(x)) for x in lat.states(chunks)[0].tolist()))}
    p = {k: math.exp(v) for k, v in every.items()}
    assert abs(sum(p.values()) - 1) < 1e-9
    # Every way to cut the text into pieces is a path, and its probability goes with the product of its pieces' weights.
    sp = sentencepiece()
    known = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}

    def ways(t):
        return [[]] if not t else [[known[t[:n]], *w] for n in range(1, len(t) + 1) if t[:n] in known for w in ways(t[n:])]

    want = {tuple(a + b): lat.weight[a + b].sum() for a in ways("▁" + chunks[0]) for b in ways("▁" + chunks[1])}
    total = np.logaddexp.reduce(list(want.values()))
    got = {tuple(lat.ids(lat.token[list(k)]).tolist()): v for k, v in every.items()}
    assert got.keys() == want.keys() and all(abs(v - (want[k] - total)) < 1e-9 for k, v in got.items())
    p = {tuple(lat.token[list(k)].tolist()): v for k, v in p.items()}
    first, second, weighted, n = Counter(), Counter(), 0.0, 20_000
    for found, bound in lat.sample_all([chunks] * n, list(range(n)), 3, 1):
        ids = [tuple(c.tolist()) for c, _, _ in found]
        assert len(set(ids)) == 3 and found[0][2] > found[1][2] > found[2][2] > bound
        assert all(abs(math.exp(lp) - p[x]) < 1e-9 for x, (_, lp, _) in zip(ids, found, strict=True))
        first[ids[0]] += 1
        second[ids[1]] += 1
        weighted += sum(p[x] / -math.expm1(-math.exp(lp - bound)) * len(x) for x, (_, lp, _) in zip(ids, found, strict=True)) / n
    assert sum(abs(first[k] / n - v) for k, v in p.items()) / 2 < 0.015
    after = {k: sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k) for k in p}
    assert sum(abs(second[k] / n - v) for k, v in after.items()) / 2 < 0.015
    assert abs(weighted - sum(len(k) * v for k, v in p.items())) < 0.01


def test_samples_decode(spark):
    df = piece_sampling.sample_segmentations(docs(spark), queries.tokenizer("piece_bpe_32k.model"), k=3)
    out = rows(df, "doc_id", "sample")
    by = {i: [r for r in out if r["doc_id"] == i] for i, _ in DOCS}
    for i, t in DOCS:
        assert all(r["decodes"] and 0 <= r["inclusion"] <= 1 for r in by[i])
        assert len({r["ids"] for r in by[i]}) == len(by[i]) == (1 if not t else len(by[i]))
        assert sorted((r["perturbed"] for r in by[i]), reverse=True) == [r["perturbed"] for r in by[i]]
    assert [r["ids_crc32"] for r in by[7]] != [r["ids_crc32"] for r in by[10]]
    text = {r.doc_id: r.text for r in piece_sampling.decode_ids(df.where("sample = 0"), queries.tokenizer("piece_bpe_32k.model")).collect()}
    assert text == {i: (t or "").replace("▁", " ") for i, t in DOCS}
    again = rows(piece_sampling.sample_segmentations(docs(spark).repartition(5), queries.tokenizer("piece_bpe_32k.model"), k=3), "doc_id", "sample")
    assert [(r["doc_id"], r["ids"]) for r in out] == [(r["doc_id"], r["ids"]) for r in again]
    assert all(abs(a[c] - b[c]) < 1e-6 for a, b in zip(out, again, strict=True) for c in ("log_prob", "perturbed", "inclusion"))


def test_the_query_returns_ids_that_decode(spark):
    out = queries.op4_piece_sampling(spark, SF)
    assert out.columns == [c.split()[0] for c in piece_sampling.SCHEMA.split(", ")]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for k in range(piece_sampling.SAMPLES):
        part = out.where(f"sample = {k}")
        got = {r.doc_id: r.text for r in piece_sampling.decode_ids(part, queries.tokenizer("piece_bpe_32k.model")).collect()}
        assert got == {i: (text[i] or "").replace("▁", " ") for i in got} and (k or got.keys() == text.keys())


# --- op10 --------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    more = [*DOCS, (50, "é" * 70_000), (51, "longer than one frame " * 80_000)]
    out = rows(media.media_round_trip(docs(spark, more)), "doc_id")
    for r, (i, t) in zip(out, more, strict=True):
        raw = (t or "").encode()
        whole = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    same = [r for r in out if r["doc_id"] in (7, 10)]
    assert same[0]["media_sha256"] == same[1]["media_sha256"] and same[0]["feature"] == same[1]["feature"]
    tensors = media.decode_media(media.store_media(docs(spark, more[:3]))).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in tensors)
    assert all(len(r["rgb"]) == 3 * sum(h * w for h, w in zip(r["heights"], r["widths"], strict=True)) for r in out) and [bytes(r.rgb) for r in sorted(tensors)] == [bytes(r["rgb"]) for r in out[:3]]
    assert len(out[-1]["heights"]) > 1 and media.media_round_trip(docs(spark, [])).collect() == []
    assert [r["media_sha256"] for r in rows(media.media_round_trip(docs(spark, [(1, "a"), (1, "a"), (None, "a")]), tensors=False), "doc_id")] == [same_a := out[3]["media_sha256"], same_a, same_a]


def test_fixed_layout_equals_bit_by_bit():
    rng = random.Random(2)
    for n in (64, 64 * 7, 64 * 40):
        data = jpeg.encode(rng.randbytes(n))
        fast, _ = jpeg.read_frame(data)
        slow, _ = jpeg.read_frame(data, fast=False)
        assert all((a == b).all() for a, b in zip(fast.coefs, slow.coefs, strict=True))


class Writer:
    """A general progressive encoder of one component for the test: runs of zeros, end-of-band runs, refinement."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def symbol(self, s):
        self.put(s, 8)  # a table of all 8-bit symbols but the last

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\0") if bits else b""


def shifted(v, low):
    return (abs(v) >> low) * (1 if v > 0 else -1)


def first_scan(blocks, a, b, low):
    w = Writer()
    for x in blocks:
        run = 0
        for k in range(a, b + 1):
            v = shifted(x[k], low)
            if not v:
                run += 1
                continue
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            w.symbol(run << 4 | abs(v).bit_length())
            w.number(v)
            run = 0
        if run:
            w.symbol(0)
    return w.data()


def refine_scan(blocks, a, b, low):
    w = Writer()
    for x in blocks:
        run, held = 0, ""
        for k in range(a, b + 1):
            now, old = shifted(x[k], low), shifted(x[k], low + 1)
            if old:
                held += str(abs(now) & 1)
            elif not now:
                run += 1
            else:
                while run > 15:  # zeros first, with the correction bits between them
                    raise AssertionError("the test keeps runs short")
                w.symbol(run << 4 | 1)
                w.put(int(now > 0), 1)
                w.bits += held
                run, held = 0, ""
        if run or held:
            w.symbol(0)
            w.bits += held
    return w.data()


def test_general_progressive_files():
    import numpy as np

    rng = random.Random(4)
    blocks = [[rng.randrange(-200, 200), *((rng.choice([0, 0, 0, rng.randrange(-40, 40)]) if k % 3 else rng.randrange(2, 9)) for k in range(63))] for _ in range(6)]
    symbols = bytes(range(255))
    dht = b"".join(jpeg._segment(0xC4, bytes([kind, 0, 0, 0, 0, 0, 0, 0, 255, 0, 0, 0, 0, 0, 0, 0, 0]) + symbols) for kind in (0, 16))
    sof = jpeg._segment(0xC2, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0]))
    dc, last = Writer(), 0
    for x in blocks:
        v = x[0] >> 1
        dc.symbol(abs(v - last).bit_length())
        dc.number(v - last)
        last = v
    low_bits = Writer()
    for x in blocks:
        low_bits.put(x[0] & 1, 1)
    scans = [(0, 0, 0, 1, dc.data()), (1, 20, 0, 2, first_scan(blocks, 1, 20, 2)), (21, 63, 0, 0, first_scan(blocks, 21, 63, 0)), (0, 0, 1, 0, low_bits.data()), (1, 20, 2, 1, refine_scan(blocks, 1, 20, 1)), (1, 20, 1, 0, refine_scan(blocks, 1, 20, 0))]
    data = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\1" * 64) + sof + dht + b"".join(jpeg._scan(1, a, b, h, lo) + d for a, b, h, lo, d in scans) + b"\xff\xd9"
    (frame,) = jpeg.read_frames(data)
    assert frame.coefs[0].reshape(-1, 64).tolist() == blocks
    flat = np.zeros((1, 64))
    flat[0, 0] = 8 * 30
    assert np.allclose(flat @ jpeg.inverse_dct(), 30, atol=1e-3)
    assert jpeg.rgb(frame).shape == (16, 24, 3)
