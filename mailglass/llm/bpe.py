"""Byte-level BPE encoding and decoding by recursive queries, one engine per worker.

A text is cut by the vocabulary's pattern; each distinct piece is encoded once per
block of pieces and remembered. A piece that is a token stands for itself. Of the
others every byte is a row (word, position, token). A recursive query joins
neighbouring rows with the merge table, contracts the leftmost pair of the least rank
of each word and repeats until no pair of any word is in the table. Where nothing that
a contraction makes can have a smaller rank, all pairs that would follow one after
another are contracted in the same step (``together``); the result is the same.
Decoding joins ids with the token table and aggregates their bytes in order.

Memory is bounded: pieces and ids go through in blocks, whatever the length of a text,
and a recursion ends after a bounded number of row copies to go on from its last state.

Defined results: a null text is an empty one, with no ids; null ids decode to no bytes;
special tokens' strings are ordinary text; an id that is no token raises an error.
Equal rows are encoded each. Other columns named in ``keep`` pass through, whatever
their names; ``token_ids`` and ``decoded`` are the output names, and an input column
of that name may not be kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.llm.shared import text_of

#: A rank file above this is refused: it is sent to every executor.
MOST_BYTES = 64 << 20
BLOCK_PIECES = 1 << 17
BLOCK_IDS = 1 << 18
#: Rows that one recursion may copy, and words remembered.
ROW_COPIES = 1 << 21
REMEMBERED = 1 << 19

#: One step: rows and their neighbours, the merge table, each word's least (rank, place), then that pair made one row.
CONTRACT = """
WITH RECURSIVE state (step, word, i, id) AS (
    SELECT 0, word, i, id FROM active
    UNION ALL
    SELECT * FROM (
        WITH pairs AS MATERIALIZED (
            SELECT step, word, i, id, made, together, behind FROM (
                SELECT *, lead(word) OVER near AS next_word, lead(id) OVER near AS next, lag(i) OVER near AS behind FROM state WHERE step < {steps} WINDOW near AS (ORDER BY i))
            LEFT JOIN merges ON a = id AND b = next AND next_word = word),
        least AS (SELECT word, min((made::BIGINT << 40) | i) AS best FROM pairs WHERE made IS NOT NULL GROUP BY word)
        {choose})),
last AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT word, step, list(id ORDER BY i) AS ids FROM state JOIN last USING (word, step) GROUP BY word, step
"""
#: The leftmost pair of the least rank.
ONE = """
        SELECT step + 1, p.word, i, CASE WHEN i = best & 1099511627775 THEN made ELSE id END FROM pairs p JOIN least USING (word)
        WHERE behind IS DISTINCT FROM best & 1099511627775"""
#: All pairs of the least rank, where they are contracted one after another anyway; of overlapping ones every other.
ALL = """
        , ranked AS (SELECT p.*, made = best >> 40 AS is_least, i = best & 1099511627775 AS is_first, row_number() OVER (ORDER BY i) AS r FROM pairs p JOIN least USING (word)),
        runs AS (SELECT *, r - sum(is_least::INT) OVER (ORDER BY i) AS run FROM ranked),
        hits AS (SELECT *, coalesce(is_least AND CASE WHEN together THEN row_number() OVER (PARTITION BY word, is_least, run ORDER BY i) % 2 = 1 ELSE is_first END, false) AS hit FROM runs)
        SELECT step + 1, word, i, CASE WHEN hit THEN made ELSE id END FROM (SELECT *, lag(hit, 1, false) OVER (ORDER BY i) AS eaten FROM hits) WHERE NOT eaten"""
#: Longer pieces are contracted by ALL.
SHORT = 48


class Vocabulary:
    """A rank file (base64 token, rank per line) and the pattern that cuts texts, as the driver read them."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = file.read(MOST_BYTES + 1)
        if len(ranks) > MOST_BYTES:
            raise ValueError(f"{path} has over {MOST_BYTES} bytes")
        self.ranks: Broadcast = spark.sparkContext.broadcast(ranks)
        self.pattern = pattern

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}


class Engine:
    """The tables of one vocabulary in an engine of this worker process."""

    def __init__(self, ranks: bytes, pattern: str):
        import duckdb
        import regex

        self.cut = regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = np.array([tokens[bytes([k])] for k in range(256)], np.int32)
        self._table("tokens", pa.table({"id": pa.array(tokens.values(), pa.int32()), "hex": [t.hex() for t in tokens], "token": pa.array(tokens, pa.binary())}))
        pairs = [(tokens[t[:k]], tokens[t[k:]], made) for t, made in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
        self._table("pairs", pa.table(dict(zip(("a", "b", "made"), map(lambda c: pa.array(c, pa.int32()), zip(*pairs) if pairs else ((), (), ()))))))
        self.con.execute("""CREATE TABLE merges AS SELECT a, b, made, made < ALL (SELECT least FROM uses u WHERE u.id = p.made) AS together FROM pairs p
            """.replace("uses", "(SELECT id, min(made) AS least FROM (SELECT a AS id, made FROM pairs UNION ALL SELECT b, made FROM pairs) GROUP BY id)"))
        self.con.execute("CREATE TABLE known AS SELECT token AS word, [id] AS ids, true AS is_token FROM tokens")

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _read(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table()

    def pieces(self, words: pa.Array) -> pa.Array:
        """Ids of each of the distinct ``words`` (binary)."""
        self._table("asked", pa.table({"n": np.arange(len(words)), "word": words}))
        self.con.execute("CREATE OR REPLACE TABLE found AS SELECT n, word, ids FROM asked LEFT JOIN known USING (word)")
        new = self._read("SELECT n, word FROM found WHERE ids IS NULL ORDER BY n")
        if len(new):
            self._table("fresh", self._contract(new))
            if self.con.execute("SELECT count(*) FROM known").fetchone()[0] > REMEMBERED:
                self.con.execute("CREATE OR REPLACE TABLE known AS SELECT * FROM known WHERE is_token")
            self.con.execute("INSERT INTO known SELECT found.word, fresh.ids, false FROM fresh JOIN found USING (n)")
            self.con.execute("CREATE OR REPLACE TABLE found AS SELECT n, coalesce(found.ids, fresh.ids) AS ids FROM found LEFT JOIN fresh USING (n)")
        return self._read("SELECT ids FROM found ORDER BY n").column("ids").combine_chunks()

    def _contract(self, new: pa.Table) -> pa.Table:
        words = new.column("word").combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        length = np.diff(bounds)
        word = np.repeat(new.column("n").to_numpy(), length)
        ids = self.bytes[np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
        short = np.repeat(length <= SHORT, length)
        return pa.concat_tables([self._until_fixed(word[short], ids[short], ONE), self._until_fixed(word[~short], ids[~short], ALL)])

    def _until_fixed(self, word: np.ndarray, ids: np.ndarray, choose: str) -> pa.Table:
        """(n, ids) per word; ``word`` says whose the ids are, in order."""
        out = [pa.table({"n": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})]
        while len(word):
            self._table("active", pa.table({"word": word, "i": np.arange(len(word)), "id": ids}))
            steps = max(1, ROW_COPIES // len(word))
            state = self._read(CONTRACT.format(steps=steps, choose=choose)).rename_columns(["n", "step", "ids"])
            more = np.asarray(state.column("step")) == steps  # these may have pairs left
            out.append(state.filter(pa.array(~more)).select(["n", "ids"]))
            state = state.filter(pa.array(more))
            lists = state.column("ids").combine_chunks()
            word = np.repeat(state.column("n").to_numpy(), np.asarray(lists.value_lengths()).astype(np.int64))
            ids = lists.flatten().to_numpy()
        return pa.concat_tables(out)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the texts, long ones in several parts, in order."""
        rows: list[int] = []
        counts: list[int] = []
        found: list[str] = []
        for row, text in enumerate(texts):
            for pieces in self._cut(text.as_py() or ""):
                rows.append(row)
                counts.append(len(pieces))
                found += pieces
                if len(found) >= BLOCK_PIECES:
                    yield from self._block(rows, counts, found)
                    rows, counts, found = [], [], []
        if found:
            yield from self._block(rows, counts, found)

    def _cut(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK_PIECES:
            yield self.cut.findall(text)
            return
        matches = self.cut.finditer(text)
        while pieces := [m.group() for m in islice(matches, BLOCK_PIECES)]:
            yield pieces

    def _block(self, rows: list[int], counts: list[int], found: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        column = pa.array(found, pa.string()).dictionary_encode()
        ids = self.pieces(column.dictionary.cast(pa.binary())).take(column.indices)
        length = np.append(0, np.cumsum(np.asarray(ids.value_lengths()), dtype=np.int64))
        ends = length[np.cumsum(counts)]
        yield from zip(rows, np.split(ids.flatten().to_numpy(), ends[:-1]))

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(row, bytes): the tokens' bytes of each row, aggregated in order."""
        for lo in range(0, len(ids), BLOCK_IDS):
            part = slice(lo, lo + BLOCK_IDS)
            self._table("given", pa.table({"i": np.arange(len(ids[part])), "row": rows[part], "id": ids[part]}))
            done = self.con.execute("SELECT row, unhex(string_agg(hex, '' ORDER BY i)), count(*) FILTER (hex IS NULL), min(given.id) FILTER (hex IS NULL) FROM given LEFT JOIN tokens USING (id) GROUP BY row ORDER BY row").fetchall()
            for row, data, strange, which in done:
                if strange:
                    raise ValueError(f"id {which} is no token")
                yield row, data


_ENGINES: dict[tuple, Engine] = {}


def _engine(vocabulary: Vocabulary) -> Engine:
    ranks = vocabulary.ranks.value
    key = (hash(ranks), vocabulary.pattern)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(ranks, vocabulary.pattern)
    return _ENGINES[key]


def _offsets(parts: list[int]) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(parts)), pa.int32())


def encode(documents: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``token_ids`` of every whole text."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(vocabulary)
        for batch in batches:
            parts = list(engine.encode(batch.column(batch.num_columns - 1)))
            lengths = np.zeros(batch.num_rows, np.int64)
            for row, ids in parts:
                lengths[row] += len(ids)
            flat = np.concatenate([ids for _, ids in parts]) if parts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(_offsets(lengths), pa.array(flat, pa.int32()))], names=[*keep, "token_ids"])

    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "token_ids array<int>"])
    return documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, shape)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the bytes of ``ids``."""
    names = encoded.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(vocabulary)
        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            rows = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
            out = [[] for _ in range(len(lists))]
            for row, data in engine.decode(flat, rows):
                out[row].append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join(x) for x in out], pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in encoded.dtypes), "decoded binary"]))
