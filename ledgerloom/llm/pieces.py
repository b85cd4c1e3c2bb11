"""SentencePiece encoding and decoding by streaming Viterbi.

The text, with a blank set before it and every blank written as U+2581, is cut into pieces of the vocabulary so that
the sum of piece scores is greatest. The search keeps a window of as many states as the longest piece has signs.
Whenever the best paths of all states of the window go through one boundary, the ids before it are final and are
handed on, so a text of any length needs the memory of a window and of the stretch not yet decided. Among equal
scores the longer last piece wins.

A sign that no piece covers is written as the bytes of its UTF-8 form, and so is U+2581 where the text itself holds it.
Decoding joins the pieces with U+2581 as a blank, turns bytes back into signs, and takes the first blank away, which
gives back every text exactly. (A vocabulary without the piece U+2581 cannot tell it from a blank; round_trip says so.)

Scores of a unigram model are used as they are. The merge ranks of a BPE model aren't log probabilities; its pieces
get those of Zipf's law by rank, -ln(rank + 2). Scores count in whole millionths, so sums are exact and ties are
ties. The model file is read by each worker from ``path``.

A null text gives null ids, an empty one no ids. Rows are encoded on their own, so copies, ties and doc_ids that
repeat or are missing change nothing. An empty table gives an empty frame; other columns pass through.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Texts of single words kept with their ids by each worker.
MEMO = 600_000
#: White space that ends a word; the next word begins with the blank that stands before it.
WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], longest: int | None = None):
        """``byte_ids``: ids of the 256 bytes. Other entries without text have an empty piece."""
        self.ids = {p: k for k, p in enumerate(pieces) if p}
        self.scores = [round(s * 1e6) for s in scores]
        self.byte_ids = byte_ids
        self.longest = longest or max(map(len, self.ids), default=1)
        #: The pieces sign by sign: a sign leads to (further signs, score, id), with id -1 inside a piece.
        self.trie: dict[str, tuple] = {}
        for piece, k in sorted(self.ids.items()):
            node = self.trie
            for sign in piece[:-1]:
                node = node.setdefault(sign, ({}, 0, -1))[0]
            below = node[piece[-1]][0] if piece[-1] in node else {}
            node[piece[-1]] = (below, self.scores[k], k)
        self.outside = min((self.scores[k] for k in self.ids.values()), default=0) - 10_000_000
        #: With a piece for the blank, bytes of U+2581 are always a sign of the text.
        self.blank = SPACE in self.ids
        self.text = [(p.replace(SPACE, " ") if self.blank else p).encode() for p in pieces]
        for byte, k in enumerate(byte_ids):
            self.text[k] = bytes([byte])
        #: No piece holds a blank after another sign, so every word is decided on its own.
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.memo: dict[str, bytes] = {}


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    plain = [not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k)) for k in range(n)]
    pieces = [model.id_to_piece(k) if ok else "" for k, ok in enumerate(plain)]
    scores = [model.get_score(k) for k in range(n)]
    if sum(s == int(s) for s in scores) > n // 2:  # merge ranks
        order = sorted((k for k, ok in enumerate(plain) if ok), key=lambda k: -scores[k])
        ranks = {k: r for r, k in enumerate(order)}
        scores = [float(-np.log(ranks[k] + 2)) if k in ranks else 0.0 for k in range(n)]
    return Vocabulary(pieces, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def viterbi(text: str, v: Vocabulary):
    """Yield lists of ids as soon as they are final. ``text`` has U+2581 for blanks."""
    trie, outside, longest = v.trie, v.outside, v.longest
    n, done = len(text), 0
    # Of each boundary from ``done`` on: its best sum, the boundary before it on that path, and the piece's id or -1.
    best, back, by = [0], [0], [-1]

    def path(end: int) -> list[int]:
        out: list[int] = []
        while end:
            start, piece = back[end], by[end]
            if piece < 0:
                out += [v.byte_ids[b] for b in reversed(text[done + start : done + end].encode())]
            else:
                out.append(piece)
            end = start
        out.reverse()
        return out

    here = far = 0
    for at in range(n):
        if here + longest >= len(best):
            more = min(n - at, 1024) + longest
            best += [-(1 << 62)] * more
            back += [0] * more
            by += [-1] * more
        base, end, node = best[here], here, trie
        for sign in text[at : at + longest]:
            found = node.get(sign)
            if found is None:
                break
            node, score, piece = found
            end += 1
            if piece >= 0 and base + score > best[end]:
                best[end], back[end], by[end] = base + score, here, piece
                if end > far:
                    far = end
        here += 1
        if base + outside > best[here]:
            best[here], back[here], by[here] = base + outside, here - 1, -1
        if far < here:
            far = here
        if far == here:  # one state is left: all before it is decided
            meet = here if here >= longest or at == n - 1 else 0
        elif here >= longest and here % longest == 0:  # the boundary where the paths of all states meet
            heads = {end for end in range(here, far + 1) if best[end] > -(1 << 62)}
            while len(heads) > 1:
                top = max(heads)
                heads.remove(top)
                heads.add(back[top])
            (meet,) = heads
        else:
            meet = 0
        if meet:
            yield path(meet)
            if at == n - 1:
                return
            done, here, far = done + meet, here - meet, far - meet
            best = [x - best[meet] if x > -(1 << 62) else x for x in best[meet:]]
            back, by = [max(0, x - meet) for x in back[meet:]], by[meet:]


def word_ids(word: str, v: Vocabulary) -> bytes:
    found = v.memo.get(word)
    if found is None:
        found = array("i", [i for part in viterbi(word, v) for i in part]).tobytes()
        if len(word) <= 64:
            if len(v.memo) >= MEMO:
                v.memo.clear()
            v.memo[word] = found
    return found


def encode(text: str, v: Vocabulary) -> np.ndarray:
    if not text:
        return np.empty(0, np.int32)
    if not v.blank or SPACE not in text:
        return run_ids(SPACE + text.replace(" ", SPACE), v)
    sign = np.array([v.byte_ids[b] for b in SPACE.encode()], np.int32)
    parts = text.split(SPACE)
    out = [run_ids(SPACE + parts[0].replace(" ", SPACE), v)]
    for part in parts[1:]:
        out += [sign, run_ids(part.replace(" ", SPACE), v)]
    return np.concatenate(out)


def run_ids(text: str, v: Vocabulary) -> np.ndarray:
    """Ids of a stretch that has U+2581 for blanks."""
    if not v.by_words:
        return np.array([i for part in viterbi(text, v) for i in part], np.int32)
    memo = v.memo
    words = WORD.findall(text)
    return np.frombuffer(b"".join([memo[w] if w in memo else word_ids(w, v) for w in words]), np.int32)


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    text = b"".join([v.text[k] for k in ids.tolist()]).decode("utf-8", "replace")
    return (text if v.blank else text.replace(SPACE, " "))[1:]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids (array<int>), n_ids and round_trip: decoding gives the text again.

    The added columns take the place of columns of these names.
    """
    path = path or default_model()
    docs = docs.drop("ids", "n_ids", "round_trip")
    columns = docs.columns

    def run(batches):
        v = load(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                found, same = [], []
                for text in part.column("text").to_pylist():
                    ids = encode(text or "", v)
                    found.append(ids)
                    same.append(None if text is None else decode(ids, v) == text)
                missing = part.column("text").is_null()
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=missing)
                counts = pa.array([None if m else len(f) for f, m in zip(found, missing.to_pylist())], pa.int64())
                arrays = [*(part.column(c) for c in columns), lists, counts, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "ids", "n_ids", "round_trip"])

    schema = T.StructType(list(docs.schema.fields)).add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "long")
    return docs.mapInArrow(run, schema.add("round_trip", "boolean"))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with decoded_text, the text of its column ``ids`` (null: null)."""
    path = path or default_model()
    columns = rows.columns

    def run(batches):
        v = load(path)
        for batch in batches:
            texts = [None if x is None else decode(np.array(x, np.int32), v) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded_text"])

    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add("decoded_text", "string"))
