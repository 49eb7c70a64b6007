"""What a worker keeps of the texts before is bounded."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers

from sparkfolio.llm import packing


def test_a_worker_keeps_few_chunks():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"{k}x{i}" for i in range(20_000)) for k in range(12)]
    batches = (pa.RecordBatch.from_pydict({"doc_id": [k], "text": [x]}) for k, x in enumerate(texts))
    most = 0
    for _ in packing._pieces(path, 2048)(batches):
        most = max(most, len(packing._store(path)))
    assert most < 200_000


def test_a_frequent_word_is_encoded_once(monkeypatch):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    single = packing._Words._single
    monkeypatch.setattr(packing._Words, "_single", lambda self, words: asked.extend(words) or single(self, words))
    packing._store.cache_clear()
    letters = str.maketrans("0123456789", "qwertyuiop")
    texts = ["frequent " + " ".join(str(40_000 * k + i).translate(letters) for i in range(40_000)) for k in range(12)]
    batches = (pa.RecordBatch.from_pydict({"doc_id": [k], "text": [x]}) for k, x in enumerate(texts))
    for _ in packing._pieces(path, 2048)(batches):
        pass
    packing._store.cache_clear()
    assert asked.count("frequent") == 1


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    texts = [None, "", " ", "Été, naïve?! ﬁn. ª º µ ÿ Ā İstanbul ét́ á can't 'll 3x x3 -- 'A' <|endoftext|> don't.'", "a  b\n\nc\t d e f \r\n!", "Wort 世界 Wort, wort; ½² WORT\n", "."]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    for rows in (batch, batch.slice(2)):
        got = [x for part in packing._pieces(path, 2048)(iter([rows])) for x in part.column("ids").to_pylist()]
        want = [b"".join(i.to_bytes(4, "little") for i in [*tool.encode(x or "", add_special_tokens=False).ids, 0]) for x in rows.column("text").to_pylist()]
        assert got == want
