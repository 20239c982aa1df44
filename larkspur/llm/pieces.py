"""SentencePiece encoding and decoding with a table of distinct chunks.

The model's pieces never hold a white-space marker after another character, so no piece reaches over the border in
front of a marker, and each chunk (markers and the word after them) is segmented by itself. Every task keeps a
table of the chunks it has met: a distinct chunk is segmented once, and a text's ids are looked up chunk by chunk and
joined by position. The table goes when its task ends, as Spark keeps the workers. Texts are taken in groups, so that a group's new chunks are segmented in one call. The table's
size is bounded, which changes no result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from larkspur.llm.arrays import release

MARKER = "▁"
TABLE_CHUNKS = 50_000
TABLE_CHARS = 2_000_000
GROUP_ROWS = 200
CHUNK = re.compile(" +[^ ]*")
TYPE = StructType([StructField("ids", BinaryType()), StructField("decoded", StringType())])


class ChunkTable:
    """Ids (unsigned 32-bit little-endian) and decoded text of the distinct chunks met lately.

    There are two generations. When the younger one is full it becomes the older one, and chunks that are met again move
    over, so that frequent chunks stay.
    """

    def __init__(self, model_path: str):
        self.model = loaded_model(model_path)
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.chars = 0

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that are not in the table, all in one call; the young generation holds all of them afterwards."""
        if len(self.young) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        new = chunks - self.young.keys()
        for chunk in new & self.old.keys():
            self.young[chunk] = self.old[chunk]
        unknown = list(new - self.old.keys())
        self.chars += sum(map(len, new))
        if not unknown:
            return
        # The library puts one marker in front, hence the chunk without its first blank.
        found = self.model.encode([c[1:] for c in unknown], num_threads=1)
        for chunk, ids, text in zip(unknown, found, self.model.decode(found)):
            text = " " + text
            self.young[chunk] = (array("I", ids).tobytes(), chunk if text == chunk else text)
        if " " in chunks:
            # A last blank alone is one marker; the library has no text for it, as it puts a marker in front itself.
            self.young[" "] = (array("I", [self.model.piece_to_id(MARKER)]).tobytes(), " ")

    def encode(self, texts: list[str], begin: bytes, end: bytes) -> list[tuple[bytes, str]]:
        chunks = [CHUNK.findall(" " + t.replace(MARKER, " ")) if t else [] for t in texts]
        self.learn(set().union(*chunks))
        made = []
        for own in chunks:
            ids, shown = zip(*map(self.young.__getitem__, own)) if own else ((), ())
            made.append((begin + b"".join(ids) + end, "".join(shown)[1:]))
        return made


@lru_cache(maxsize=1)
def loaded_model(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def pieces_fit_chunks(model_path: str) -> bool:
    """Whether no piece of the model holds a marker after another character."""
    model = loaded_model(model_path)
    return not any(MARKER in model.id_to_piece(i).lstrip(MARKER) for i in range(model.get_piece_size()))


def encoder(model_path: str, text: str, keep: list[str], begin: bool, end: bool):
    """For mapInArrow: the kept columns and the pieces of each row, GROUP_ROWS rows at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ChunkTable(model_path)
        first = held.model.bos_id().to_bytes(4, "little") if begin else b""
        last = held.model.eos_id().to_bytes(4, "little") if end else b""
        for whole in batches:
            for lo in range(0, whole.num_rows, GROUP_ROWS):
                batch = whole.slice(lo, GROUP_ROWS)
                made = held.encode([t or "" for t in batch.column(text).to_pylist()], first, last)
                ids, decoded = pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())
                struct = pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], struct], names=[*keep, "_pieces"])
        del held
        release()

    return rows


def encode_documents(
    docs: DataFrame, model_path: str, text: str = "text", into: str = "pieces", keep: list[str] | None = None,
    begin: bool = True, end: bool = True,
) -> DataFrame:
    """Every row of ``docs`` with a struct ``into`` of ``ids`` (binary, unsigned 32-bit little-endian) and ``decoded`` text.

    Equal to the library's ids without sampling and to its decoding of them. A null or empty text has the begin and end
    ids only. Repeated rows stay; a column named ``into`` is replaced; ``keep`` names the other columns, all by default. Needs a
    model whose white space stays as it is and whose pieces fit chunks; raises otherwise.
    """
    if not pieces_fit_chunks(model_path):
        raise ValueError("pieces of this model reach over white space")
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    fields = [f for f in docs.schema.fields if f.name in kept]
    made = docs.select(*dict.fromkeys([*kept, text])).mapInArrow(
        encoder(model_path, text, [f.name for f in fields], begin, end), StructType([*fields, StructField("_pieces", TYPE)])
    )
    return made.withColumnRenamed("_pieces", into)
