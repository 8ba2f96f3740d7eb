import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from inkgrid.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \n\t", "It's we'll I'D they've 'sample", "ΑΣ ΣΑΣ ß İstanbul ŉ", "é café ﬁ ½ ٣٤ 12345", "a b c\u0085d\x1ce\x1ff", "<|startoftext|>Hello<|endoftext|> <|ENDOFTEXT|>",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "hahahahahahahahaha", "x" * 5000, "日本語テキスト 🙂🙃👍👍👍 \u0000 a\u0000", "!!!???...---===", "ab" * 3000 + "​", "<|startoftext|><|startoftext|>", "naïve Ünïcödé ǅ K",
]


def compare(texts):
    theirs = Tokenizer.from_file(PATH)
    ours = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert bpe.np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert ours.decode([ids])[0] == theirs.decode(want, skip_special_tokens=False)
    return ours


def test_odd_texts():
    compare(ODD)


def test_random_words():
    rng = random.Random(3)
    vocabulary = list(bpe.Vocabulary(open(PATH, encoding="utf-8").read()).ids)
    mapped = {c: b for b, c in enumerate(bpe.byte_characters())}
    texts = []
    for _ in range(3000):
        token = "".join(rng.choice(vocabulary).replace("</w>", "") for _ in range(rng.randint(1, 6)))
        texts.append(bytes(mapped[c] for c in token).decode("utf-8", "ignore"))
    texts += ["".join(rng.choice("aehtins") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ours = compare(texts)
    assert 0 < ours.merged < len(texts)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(None, None, None)], docs.schema))
    theirs = Tokenizer.from_file(PATH)
    out = bpe.encode(docs, PATH, decoded="back").collect()
    assert len(out) == 201
    for r in out:
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert bpe.np.frombuffer(r.ids, "<u4").tolist() == want and r.back == theirs.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_workers_keep_no_pieces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(4)
    bpe.encode(docs, PATH).write.format("noop").mode("overwrite").save()

    def held(batches):
        for _ in batches:
            yield bpe.pa.RecordBatch.from_pydict({"vocabularies": [len(bpe._LOADED)], "pieces": [sum(len(v.new) + len(v.old) for v in bpe._LOADED.values())]})

    rows = bpe.map_arrow(spark.range(0, 64, 1, 4), held, "vocabularies long, pieces long").collect()
    assert sum(r.vocabularies for r in rows) and not sum(r.pieces for r in rows)
