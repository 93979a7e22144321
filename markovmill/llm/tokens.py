"""Token counts of whole texts; huge ones by chunks that overlap and resynchronise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .encoding import encode_all, shared_encoder

CHUNK, OVERLAP = 16_384, 512


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row. tokenizer: path of a tokenizers file, there on each machine;
    ranks: of the same vocabulary as a file of ranks, which is used as far as it is proven to give the same ids (see encoding).

    Texts over chunk + overlap characters are encoded in chunks that are spliced where they agree (see encoding); if the file is not of a
    kind that proves where that is, they are encoded whole.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows and ids: a row each. No rows: no rows. Other columns aren't read. One scan, no
    shuffle; a worker holds one slice of texts, and of a huge text the ids and two chunks.
    """
    if chunk < 1 or overlap < 1:
        raise ValueError("chunk and overlap must be positive")
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make():
        encoder = shared_encoder(tokenizer, ranks)

        def count(part):
            texts = part.column("text").to_pylist()
            counts = [len(ids) for ids in encode_all(encoder, texts, chunk, overlap)]
            return {"key_": part.column("key_").to_pylist(), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return count

    kind = rows.schema["key_"].dataType.simpleString().replace("bigint", "long")
    return map_rows(rows, make, f"key_ {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key_", key)
