import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from tapeloom.llm.common import shared_path
from tapeloom.llm.decontaminate import benchmark_leaks
from tapeloom.llm.secrets import scan_secrets, secret_report
from tapeloom.llm.substrings import remove_repeats
from tapeloom.llm.tokens import count_tokens

LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(60))
TEXTS = [None, "", "a", LONG, "x " + LONG + " y", LONG, "AKIA" + "A" * 20 + ' Token: "abcdefghijkl" 0123456789abcdef', "a  b\n c <|endoftext|> é　z" * 30]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_repeats_against_brute_force(spark):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = bytes(c for c, m in zip(b, hit, strict=True) if not m)
    assert {r.doc_id: bytes(r.kept) for r in remove_repeats(docs(spark)).collect()} == want


def test_tokens_against_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, cache = Tokenizer.from_file(path), shared_path(spark, "cache")
    want = {i: len(model.encode(t or "", add_special_tokens=False)) for i, t in enumerate(TEXTS)}
    for _ in range(2):  # the second time all from the cache
        assert {r.doc_id: r.n_tokens for r in count_tokens(docs(spark), path, cache).collect()} == want


def test_secrets(spark):
    r = {x.doc_id: x for x in secret_report(scan_secrets(docs(spark))).collect()}
    assert (r[6].n_assign, r[6].n_access, r[6].n_hex) == (1, 1, 1) and r[6].spans == "access:0:24,assign:25:45,hex:47:63"
    assert r[6].base_sha256 == hashlib.sha256(r[6].spans.encode()).hexdigest() and r[0].spans == ""


def test_leaks(spark):
    items = spark.createDataFrame([(9, LONG.upper().replace("W133 ", "other ")), (8, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in benchmark_leaks(docs(spark), items).collect()) == [(3, 9), (4, 9), (5, 9)]
