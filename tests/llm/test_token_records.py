import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobmargin.llm import token_records as t
from jobmargin.session import run_folder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = [
    "The dog's isn't <|endoftext|> a<|x b’s Ünïté ½ x² İ Σας é a̸ 12.5km ’’ l'été don't!!! __init__ \x0b\x1c z",
    "A.B,C'd 'S 'll`~ ŉ ſ ÷× ÀÉÎ", "", "CiÓNŸ ß ẞ ﬁ",
]


def plain(docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows, start = [], 0
    source = [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]
    for doc_id, text in sorted(source, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_encoder_equals_the_tokenizer(documents):
    tokenizer, encoder = Tokenizer.from_file(PATH), t.Encoder(PATH)
    for text in ODD + [r["text"] for r in documents.collect()]:
        assert np.frombuffer(encoder(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(documents):
    got = sorted(tuple(r) for r in t.token_records(documents, PATH).collect())
    assert got == plain(documents)


def test_edges(spark, edge_docs, no_docs):
    got = t.token_records(edge_docs, PATH).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(r[2:] for r in plain(edge_docs))
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:2] == [None, None]
    assert t.token_records(no_docs, PATH).collect() == []


def test_shuffled_reads_files_and_damage(spark, documents, monkeypatch):
    folder = run_folder(spark, "records-test")
    manifest = t.write_records(documents, PATH, folder)
    in_order = {r["doc_id"]: (r["start"], r["ids"]) for r in t.read_records(manifest, folder).collect()}
    shuffled = t.read_records(manifest, folder, shuffle_seed=3).collect()
    assert {r["doc_id"]: (r["start"], r["ids"]) for r in shuffled} == in_order
    name = manifest.first()["file"]
    path = folder.removeprefix("file://") + f"/{name}.records"
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="DamagedRecord"):
        t.record_digests(manifest, folder).collect()


def test_read_back_has_as_many_tasks_as_its_bytes_ask_for(spark, documents, monkeypatch):
    folder = run_folder(spark, "records-test")
    manifest = t.write_records(documents, PATH, folder)
    ids = manifest.agg({"ids": "sum"}).first()[0]
    assert t.record_digests(manifest, folder).rdd.getNumPartitions() == 1
    monkeypatch.setattr(t, "READ_BYTES", 4 * ids // 7)
    monkeypatch.setattr(t, "RECORDS_AT_ONCE", 5)
    found = t.record_digests(manifest, folder)
    assert found.rdd.getNumPartitions() == 8 and found.count() == documents.count()


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", (True, True)), ("byte_bpe_50k.json", (False, False))])
def test_shortcuts_are_taken_only_for_their_kind_of_tokenizer(documents, name, kind):
    path = str(public_tokenizers.path(name))
    tokenizer, encoder = Tokenizer.from_file(path), t.Encoder(path)
    assert t.shortcuts(tokenizer) == kind
    for text in ODD + [r["text"] or "" for r in documents.limit(60).collect()]:
        assert np.frombuffer(encoder(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
