"""The caches of a worker: tasks of one operator share them, a task of another drops them."""

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle

from itemloom.llm import sentence_pieces, texts
from itemloom.llm.queries import PIECE_MODEL


def test_tasks_share_caches_and_others_drop_them(spark, monkeypatch):
    """What a task gets is a copy of its closure; the caches must not be copied with it."""
    sent = []
    monkeypatch.setattr(sentence_pieces, "map_texts", lambda docs, columns, by_piece, schema, **more: sent.append(by_piece))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    path = public_tokenizers.path(PIECE_MODEL)
    sentence_pieces.encode_documents(docs, path)
    values = ["the cat, the dog", "two  spaces, \n the\n\nline ", "▁the ▁▁cat", "über日本 語🙂🙂", "the,the the", ""]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    sentence_pieces.drop_caches()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(values))), "text": values})
    for _ in range(2):
        made = cloudpickle.loads(cloudpickle.dumps(sent[0]))()(batch)
        assert made["ids"].to_pylist() == [",".join(map(str, library.encode(v))) for v in values]
        assert made["decoded"].to_pylist() == [library.decode(library.encode(v)) for v in values]
        words, runs = sentence_pieces.caches_of(path)
        assert "the" in words.young and "▁the" not in runs.young
    texts.begin(sentence_pieces.__name__)
    assert sentence_pieces.caches_of(path)[0] is words
    texts.begin("another")
    assert sentence_pieces.caches_of(path)[0] is not words and not sentence_pieces.caches_of(path)[0].young


def test_a_word_is_looked_up_once_in_a_piece(spark, monkeypatch):
    """Repeated words of a piece cost one lookup; pair tests are remembered without a key of their own."""
    sent, looked = [], []
    monkeypatch.setattr(sentence_pieces, "map_texts", lambda docs, columns, by_piece, schema, **more: sent.append(by_piece))
    path = public_tokenizers.path(PIECE_MODEL)
    sentence_pieces.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)

    class Counted(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    values = ["the cat\nand the dog " * 500 + "end", " odd  one", "", "the end"]
    sentence_pieces.drop_caches()
    sentence_pieces.caches_of(path)[0].young = Counted()
    made = sent[0]()(pa.RecordBatch.from_pydict({"doc_id": list(range(len(values))), "text": values}))
    assert len(looked) < 50
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert made["ids"].to_pylist() == [",".join(map(str, library.encode(v))) for v in values]
    assert made["decoded"].to_pylist() == [library.decode(library.encode(v)) for v in values]
    assert made["n_tokens"].to_pylist() == [len(library.encode(v)) for v in values]
    sentence_pieces.drop_caches()
