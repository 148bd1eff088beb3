"""The registered queries on real tables against plain versions of what they return."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash

from tramline.llm import queries

AT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{AT}/documents.parquet").collect()}


def found(spark, query):
    rows = query(spark, AT).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = found(spark, queries.op1_sentencepiece)
    assert set(got) == set(docs)
    for doc, r in docs.items():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids)))


def test_op3(spark, docs):
    got, order = found(spark, queries.op3_fingerprints), sorted(docs, reverse=True)
    for i, doc in enumerate(order):
        text, other = docs[doc]["text"] or "", docs[order[(i + 1) % len(order)]]["text"] or ""
        k = len(text) // 2
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(text[: len(text) - k] + other[:k]) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = {}
    assert all(same.setdefault(docs[d]["text"], r["fingerprint"]) == r["fingerprint"] for d, r in got.items()) and len(set(same.values())) == len(same)


def test_op4(spark, docs):
    got, same = found(spark, queries.op4_media), {}
    for doc, r in got.items():
        raw = (docs[doc]["text"] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > len(payload) and same.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op5(spark, docs):
    got = found(spark, queries.op5_language)
    known = {r["lang"] for r in docs.values() if r["lang"]}
    assert set(got) == set(docs) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1 for d, r in got.items())
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[d]["text"] or "")) for d, r in got.items())
    held = [r["lang_pred"] == docs[d]["lang"] for d, r in got.items() if r["held_out"] and docs[d]["lang"]]
    assert np.mean(held) >= 0.95


def test_op6(spark, docs):
    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces, places = {}, {}
    for r in queries.op6_packing(spark, AT).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    total = 0
    for doc, rows in pieces.items():
        ids = [*own.encode(docs[doc]["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and rows[0]["start"] == 0 and sum(r["length"] for r in rows) == len(ids) and (len(rows) == 1) == (len(ids) <= 2048)
        for r in rows:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and (r["piece"] == 0 or r["length"] == 2048)
    for own_places in places.values():
        own_places.sort()
        assert own_places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own_places, own_places[1:])) and sum(own_places[-1]) <= 2048
    assert len(places) <= 1.1 * total / 2048 + 1


def test_op9(spark, docs):
    got, prints = found(spark, queries.op9_simhash), {}
    for doc, r in docs.items():
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{prints[d]:016x}", top(d)) for d in prints}


def test_op10(spark, docs):
    got = found(spark, queries.op10_secrets)
    kinds = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    for doc, r in got.items():
        text, spans = docs[doc]["text"] or "", []
        for k, (kind, pattern, group, least) in enumerate(kinds):
            own = [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
            assert r[f"n_{kind}"] == len(own)
            spans += own
        base = ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r["base_sha256"] == sha(base) and [x for x in r["spans"].split(",") if x and not x.startswith("net:")] == [x for x in base.split(",") if x]


def test_columns(spark):
    """The columns that the queries promise come first, in order."""
    promised = {
        "op2_url_filter": "page_id host path rule verdict", "op7_substring_dedup": "doc_id n_words n_removed kept_sha256", "op8_toxicity": "doc_id held_out score predicted", "op11_resampling": "doc_id n_features weight score rank",
        "op12_substrings": "doc_id n_bytes n_removed n_spans kept_sha256", "op13_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    }
    for name, columns in promised.items():
        assert queries.queries()[name](spark, AT).columns[: len(columns.split())] == columns.split()
