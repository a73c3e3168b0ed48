"""Encoding and decoding with a SentencePiece model of the merge type.

The library merges the neighbours whose joint piece scores highest, leftmost
first, until none is left.  Here the same result comes from a search:

* An Aho-Corasick automaton finds the longest piece that begins at a place; shorter
  candidates are its prefixes.
* Two adjacent tokens are compatible if merging their joined characters again
  gives back just these two.  A sequence is the library's result exactly if all its
  adjacent tokens are compatible, so no merge of the whole text is needed.
* Where no candidate is compatible with the token before, that place is marked in
  a bitfield of failed positions and the token before is taken back and tried
  shorter.  Every place fails at most once, so the search is linear.

No piece reaches from a letter to the blank that begins the next word, so words are
encoded apart, and a task remembers the words it has met.  The model file is only
read for its pieces, scores and kinds.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from episodica.llm.common import require

#: the blank inside pieces
BLANK = "▁"

#: a worker remembers the ids of up to twice as many words, and the longest it remembers
CACHED_WORDS = 250_000
CACHED_CHARS = 48

#: marks that may end a word
MARKS = ".,;:!?"

#: compatibility answers a worker remembers
CACHED_PAIRS = 1 << 18


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    """Model file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _each_byte(error: UnicodeError):
    return "�", error.start + 1


# an invalid byte becomes one replacement character of its own, as in the library
codecs.register_error("episodica-each-byte", _each_byte)


class _Words(dict):
    """Words and their ids in two generations: what is used again outlives the older one."""

    def __init__(self, code):
        self.code, self.old = code, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.code(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class PieceCodec:
    """Text -> ids -> text with the pieces of one model."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        self.ids = {sp.id_to_piece(i): i for i in sorted(set(range(n)).difference(special))}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self._check(sp)

        self.code = "H" if n <= 1 << 16 else "I"
        # a line end that no piece holds parts words as a blank does
        self.line_end = "\n" if not any("\n" in p for p in self.ids) else None
        # so does a mark behind a letter if no piece has the two together
        tied = {(x, y) for p in self.ids for x, y in zip(p, p[1:]) if y in MARKS}
        self.loose = {x for x in map(chr, range(0x250)) if x.isalpha() and not any((x, m) in tied for m in MARKS)}
        self.cut = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in self.ids:
            self.matches.add_word(p)
        self.matches.make_automaton()
        self.most = max(map(len, self.ids))
        self.shorter = lru_cache(CACHED_PAIRS)(self._shorter)
        self.fits = lru_cache(CACHED_PAIRS)(self._fits)
        self.coded: dict[str, bytes] = {}
        # words as they stand, and words behind a blank (written without it)
        self.plain = _Words(self.word)
        self.behind = _Words(lambda w: self.word(BLANK + w))

        spoken = [sp.id_to_piece(i).replace(BLANK, " ").encode() for i in range(n)]
        for i in special:
            spoken[i] = sp.decode([i]).encode() if sp.is_unknown(i) else b""
        for b, i in self.bytes.items():
            spoken[i] = bytes([b])
        self.spoken = spoken
        # the same side by side, for whole arrays of ids
        self.flat = np.frombuffer(b"".join(spoken), np.uint8)
        self.size = np.array([len(x) for x in spoken], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.led = {i for p, i in self.ids.items() if p[0] == BLANK}
        self.odd = np.zeros(n, bool)
        self.odd[list(self.silent)] = True
        self.leads = np.zeros(n, bool)
        self.leads[list(self.led)] = True

    def _check(self, sp) -> None:
        """Raise for models whose text or merges follow other rules."""
        probe = "a  b éＡ ①"
        ids = sp.encode(probe, out_type=str)
        plain = [p for p in ids if not re.fullmatch(r"<0x[0-9A-F]{2}>", p)]
        if "".join(plain) != "".join(c for c in BLANK + probe.replace(" ", BLANK) if c in self.ids) or sp.encode(""):
            raise ValueError("the model normalises text; only plain text with a leading blank is supported")
        if any(sp.is_unused(i) for i in range(sp.get_piece_size())) or len(self.bytes) not in (0, 256):
            raise ValueError("the model has unused pieces or some bytes only")
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("the model has pieces that reach over a blank")
        times = Counter(self.score.values())
        if any(times[s] > 1 and len(set(p)) > 1 for p, s in self.score.items()):
            raise ValueError("pieces of equal score must be runs of one character")

    def merge(self, s: str) -> list[str]:
        """Merge by the rule itself: best score, leftmost first."""
        parts, score = list(s), self.score.get
        while len(parts) > 1:
            joint = [(v, -i) for i in range(len(parts) - 1) if (v := score(parts[i] + parts[i + 1])) is not None]
            if not joint:
                break
            i = -max(joint)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _shorter(self, token: str) -> str | None:
        """The next candidate at the same place: the longest shorter piece, in the end the letter."""
        return next((token[:k] for k in range(len(token) - 1, 0, -1) if k == 1 or token[:k] in self.ids), None)

    def compatible(self, before: str, token: str) -> bool:
        """Whether merging the two tokens' letters again ends in the two (a word's first token: in itself)."""
        return self.merge(before + token) == ([before, token] if before else [token])

    def _fits(self, before: str, token: str | None) -> str | None:
        """The longest candidate, from ``token`` downwards, that is compatible with the token before."""
        while token is not None and not self.compatible(before, token):
            token = self.shorter(token)
        return token

    def longest(self, word: str, at: int) -> str:
        """The longest piece that begins at a place of a word, else its letter."""
        part = word[at : at + self.most]
        # so many letters stay on a path of the automaton; pieces end somewhere on it
        k = self.matches.longest_prefix(part)
        while k > 1 and part[:k] not in self.ids:
            k -= 1
        return part[: k or 1]

    def pieces(self, word: str) -> list[str]:
        """The tokens of a word by backtracking."""
        n, fits, longest = len(word), self.fits, self.longest
        failed = 0 if n < 64 else bytearray(n // 8 + 1)
        tokens: list[str] = []
        at, before, token = 0, "", longest(word, 0)
        while True:
            token = fits(before, token)
            if token is None:
                # no way on from here: the token before has to end elsewhere
                if n < 64:
                    failed |= 1 << at
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(token)
                before = tokens[-1] if tokens else ""
                token = self.shorter(token)
                continue
            end = at + len(token)
            if failed and (failed >> end if n < 64 else failed[end >> 3] >> (end & 7)) & 1:
                token = self.shorter(token)
                continue
            tokens.append(token)
            if end == n:
                return tokens
            at, before, token = end, token, longest(word, end)

    def token(self, token: str) -> bytes:
        """Ids of a token: its own, or those of its bytes if it is a letter that no piece is."""
        i = self.ids.get(token)
        ids = [i] if i is not None else [self.bytes[b] for b in token.encode()] if self.bytes else [self.unknown]
        got = array(self.code, ids).tobytes()
        if i is not None:
            self.coded[token] = got
        return got

    def word(self, word: str) -> bytes:
        """Ids of a word as machine integers."""
        core = word.rstrip(MARKS)
        if core != word and core and core[-1] in self.loose:
            return (self.behind[core[1:]] if core[0] == BLANK else self.plain[core]) + self.plain[word[len(core) :]]
        known = self.coded.get
        return b"".join([known(p) or self.token(p) for p in self.pieces(word)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as machine integers (``code`` is their array type)."""
        if not text:
            return b""
        out, end = [], self.line_end
        for i, line in enumerate(text.split(end) if end else [text]):
            if i:
                out.append(self.plain[end])
            if BLANK in line or "  " in line or line[:1] == " " or line[-1:] == " " or not line:
                line = line.replace(" ", BLANK)
                out += map(self.plain.__getitem__, self.cut(line if i else BLANK + line) if line or not i else ())
            elif i:
                first, *rest = line.split(" ")
                out.append(self.plain[first])
                out += map(self.behind.__getitem__, rest)
            else:
                out += map(self.behind.__getitem__, line.split(" "))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that encoding put in front is taken off again."""
        if not self.silent.isdisjoint(ids):
            # a control id says nothing, but parts the bytes on its sides
            runs = [[]]
            for i in ids:
                runs.append([]) if i in self.silent else runs[-1].append(i)
            runs = [r for r in runs if r]
        else:
            runs = [ids] if ids else []
        raw = [b"".join(map(self.spoken.__getitem__, r)) for r in runs]
        if raw and runs[0][0] in self.led:
            raw[0] = raw[0][1:]
        return "".join([r.decode("utf-8", "episodica-each-byte") for r in raw])


    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of several rows of ids (``ends`` of each row): bytes of all of them are gathered at once."""
        out = []
        for part in range(0, len(ends), 1000):
            upto = ends[part : part + 1000]
            begin = int(ends[part - 1]) if part else 0
            out.append(self._gather(ids[begin : int(upto[-1])], upto - begin))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def _gather(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        size, start = self.size[ids], self.start[ids]
        first = np.concatenate([[0], ends[:-1]])
        first = first[first < ends]
        led = first[self.leads[ids[first]]]
        size[led] -= 1
        start[led] += 1
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if max(total, len(self.flat)) < 1 << 31 else np.int64
        where = np.repeat((start - upto + size).astype(kind), size)
        where += np.arange(total, dtype=kind)
        edges = np.concatenate([[0], upto])[np.concatenate([[0], ends])]
        text = pa.StringArray.from_buffers(len(ends), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(self.flat[where]))
        try:
            if not self.odd[ids].any():
                text.validate(full=True)
                return text
        except pa.ArrowInvalid:
            pass
        # control ids or bytes that are no text
        flat = ids.tolist()
        return pa.array([self.decode(flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.string())


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The worker's codec of a model."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


# ---------------------------------------------------------------- Spark
def encode_pieces(text: str | Column, model_file: str) -> Column:
    """Ids of a text column, ``array<int>``; null and empty texts have none."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c = codec(model_file)
        parts = [c.encode(t) for t in texts.to_pylist()]
        dtype = np.dtype("<u2" if c.code == "H" else "<u4")
        ends = np.cumsum([0] + [len(p) // dtype.itemsize for p in parts])
        flat = np.frombuffer(b"".join(parts), dtype=dtype).astype("<i4")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return ids(F.col(text) if isinstance(text, str) else text)


def decode_pieces(ids: str | Column, model_file: str) -> Column:
    """Text of an id column; null counts as no ids, an id outside of the model is an error."""
    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        return codec(model_file).decode_all(lists.flatten().to_numpy(zero_copy_only=False), ends)

    return text(F.col(ids) if isinstance(ids, str) else ids)


def piece_round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids (``array<int>``) and decoded text of every row.

    Null and empty texts give no ids and an empty text; repeated rows and rows
    without an id are rows like any other; other columns are not read.
    """
    require(docs, id_col, text_col)
    d = docs.select(F.col(id_col).alias(id_col), encode_pieces(F.col(text_col), model_file).alias("ids"))
    return d.withColumn("decoded", decode_pieces("ids", model_file))
