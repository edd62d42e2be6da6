"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

The vocabulary writes a space as U+2581 and has no piece with that mark after
another character (checked when it is loaded), so no merge crosses the start of
a run of marks. A text falls into pre-tokens there, each one a run of marks and
what follows; the number of pieces of a text is the sum over its pre-tokens.

1. A block of texts sends its distinct pre-tokens, compressed, to the ranges of
   their hashes. A range encodes each of its distinct pre-tokens once and
   answers every block with the numbers of pieces, in the block's order.
2. The block's frequencies (document, pre-token, how often), as compressed
   numbers, meet the answers and are summed. Ids are never kept, and neither
   texts nor document-word rows travel.

The table is read twice and in one order; answers that don't fit a block are
an error.

Cases: null and empty texts have no bytes and no tokens; a very long text is a
block of its own, and a very long pre-token is encoded whole; a null doc_id is
carried; extra columns are ignored, whatever their names; equal rows give equal
rows; an empty table gives an empty result; a missing vocabulary is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, packed, table, unpacked

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: No byte of UTF-8 text.
BETWEEN = b"\xff"
#: Bytes of text that a block holds at least: more of them share their pre-tokens, and take more memory.
BLOCK = 1 << 23


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str | None) -> Counter:
    """Pre-tokens of a text with their frequencies, each without the one mark that the encoder puts before it."""
    if not text:
        return Counter()
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and not text.startswith(" "):
        return Counter(text.split(" "))  # an empty one stands for a mark alone at the end
    return Counter(x[1:] for x in re.findall(r" +[^ ]+| +$", " " + text))


class Counted:
    """Piece counts by sentencepiece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [x for x in self.model.id_to_piece(list(range(self.model.get_piece_size()))) if MARK in x.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces of this vocabulary cross pre-tokens: {crossing[:3]}")

    def of(self, words: list[str]) -> list[int]:
        """Numbers of pieces of pre-tokens; an empty one is a mark alone."""
        out = []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            out += [len(x) if w else 1 for w, x in zip(part, self.model.encode(part, num_threads=1), strict=True)]
        return out


def _bags(held: list[pa.RecordBatch]) -> list[Counter]:
    return [pre_tokens(t.as_py()) for piece in held for t in piece.column("text")]


def _dealt(bags: list[Counter], parts: int) -> list[tuple[int, list[bytes]]]:
    """The distinct pre-tokens of a block by range, in one order."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(set().union(*bags)):
        raw = w.encode("utf-8", "surrogatepass")
        out.setdefault(crc32(raw) * parts >> 32, []).append(raw)
    return sorted(out.items())


def asked(docs: DataFrame, parts: int) -> DataFrame:
    """``block``, ``part`` and ``blob``: the distinct pre-tokens of each block of texts, by range."""

    def run(batches):
        for number, held in blocks(batches, BLOCK):
            ranges = _dealt(_bags(held), parts)
            blobs = [pa.compress(BETWEEN.join(words), codec="zstd", asbytes=True) for _, words in ranges]
            sizes = [sum(map(len, words)) + len(words) - 1 for _, words in ranges]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ranges), pa.int64()), pa.array([p for p, _ in ranges], pa.int32()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "part", "size", "blob"])

    return docs.mapInArrow(run, "block long, part int, size long, blob binary")


def answered(questions: DataFrame, path: str | None) -> DataFrame:
    """The questions with numbers of pieces for pre-tokens; each distinct one of a range is encoded once."""

    def count(group: pa.Table) -> pa.Table:
        counter = Counted(path or vocabulary_path())
        lists = [pa.decompress(b.as_py(), decompressed_size=n, codec="zstd", asbytes=True).split(BETWEEN) if n else [b""] for n, b in zip(group.column("size").to_pylist(), group.column("blob"), strict=True)]
        distinct = list(set().union(*lists))
        pieces = dict(zip(distinct, counter.of([w.decode("utf-8", "surrogatepass") for w in distinct]), strict=True))
        blobs = [packed(np.array([pieces[w] for w in words], dtype=np.uint64)) for words in lists]
        return group.select(["block", "part"]).append_column("blob", pa.array(blobs, pa.binary()))

    return questions.groupBy("part").applyInArrow(count, "block long, part int, blob binary")


def frequencies(docs: DataFrame, parts: int) -> DataFrame:
    """``block``, ``part`` (-1) and ``blob``: ids, sizes and pre-token frequencies of the texts of each block."""

    def run(batches):
        for number, held in blocks(batches, BLOCK):
            bags = _bags(held)
            place = {w.decode("utf-8", "surrogatepass"): i for i, w in enumerate(w for _, words in _dealt(bags, parts) for w in words)}
            at = [np.array([place[w] for w in bag], dtype=np.uint64) for bag in bags]
            many = np.array([n for bag in bags for n in bag.values()], dtype=np.uint64)
            order = [np.argsort(x) for x in at]
            begin = np.cumsum([0] + [len(x) for x in at])
            many = many[np.concatenate([o + b for o, b in zip(order, begin[:-1], strict=True)])] if len(many) else many
            steps = np.concatenate([np.diff(x[o], prepend=np.uint64(0)) for x, o in zip(at, order, strict=True)])
            ids = pa.chunked_array([piece.column("doc_id") for piece in held]).cast(pa.int64()).combine_chunks()
            n_bytes = [len((t.as_py() or "").encode()) for piece in held for t in piece.column("text")]
            rows = pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array([len(x) for x in at], pa.int64()), pa.array([len(place)] * len(at), pa.int64())], names=["doc_id", "n_bytes", "distinct", "known"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            head = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([len(head).to_bytes(8, "little") + head + packed(steps, many)], pa.binary())], names=["block", "part", "blob"])

    return docs.mapInArrow(run, "block long, part int, blob binary")


def counted(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    ``path`` is the vocabulary file; without one each worker asks the public
    package, so nothing is copied from the driver.
    """
    docs = docs.select("doc_id", "text")
    parts = max(64, 4 * docs.rdd.getNumPartitions())

    def total(group: pa.Table) -> pa.Table:
        told = dict(sorted((p, b.as_py()) for p, b in zip(group.column("part").to_pylist(), group.column("blob"), strict=True) if p >= 0))  # equal blocks have equal answers
        pieces = np.concatenate([np.zeros(0, np.uint64), *(unpacked(b, 1)[0] for b in told.values())]).astype(np.int64)
        out = []
        for p, blob in zip(group.column("part").to_pylist(), group.column("blob"), strict=True):
            if p >= 0:
                continue
            blob = blob.as_py()
            end = 8 + int.from_bytes(blob[:8], "little")
            rows = pa.ipc.open_stream(blob[8:end]).read_all()
            size, known = rows.column("distinct").to_numpy(), rows.column("known").to_numpy()
            if len(pieces) != known[0]:
                raise RuntimeError("the documents were not read in the same order again")
            steps, many = (x.astype(np.int64) for x in unpacked(blob[end:], 2))
            begin = np.cumsum(size) - size
            places = np.cumsum(steps)
            # Places are written as steps from the one before, in each text anew.
            places -= np.repeat(np.append(0, places)[begin], size)
            sums = np.append(0, np.cumsum(pieces[places] * many))
            n_tokens = sums[begin + size] - sums[begin]
            out.append(pa.table([rows.column("doc_id"), rows.column("n_bytes"), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]))
        if not out:
            raise RuntimeError("the documents were not read in the same order again")
        return pa.concat_tables(out)

    both = frequencies(docs, parts).unionByName(answered(asked(docs, parts), path))
    return both.groupBy("block").applyInArrow(total, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and piece_bpe_32k tokens of every document."""
    return counted(table(spark, sf_dir, "documents"))
