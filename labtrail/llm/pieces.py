"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's characters are its first symbols; an agenda of adjacent pairs that make a piece is worked off in the order of
scores (then from the left), each merge putting the pairs that it makes on the agenda. Where no piece holds a blank after
another character, merges never pass the start of a word, so the text is cut there and each task keeps the words it has
seen. What the agenda makes of new words is checked against the sentencepiece library, both ways, in every block of
texts of an Arrow batch; a difference is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm.common import sha256_hex, table
from labtrail.llm.words import blocks

BLANK = "▁"
#: Words that a task keeps; then it begins anew. Bounds its memory, not its results.
KEPT_WORDS = 250_000
#: So many words are checked against the library in one text.
CHECKED = 512
NONE = 1 << 30
#: Longer words aren't kept, and have an agenda of their own.
KEPT_CHARS = 64


class Pieces:
    """A merge-type vocabulary without a normaliser's rules, read from a model file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.text = {i: p.replace(BLANK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = frozenset(self.bytes.values())
        self.end = lib.eos_id()
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.words: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.digits = [str(i) for i in range(n)]
        self.piece = {i: t.decode(errors="replace") for i, t in self.text.items()}
        self.char = -1 - np.arange(0x110000)  # a character without a piece of its own: negative
        singles = [(ord(p), i) for p, i in self.ids.items() if len(p) == 1]
        self.char[[c for c, _ in singles]] = [i for _, i in singles]
        order = {s: k for k, s in enumerate(sorted(set(self.score.values())))}
        pairs = sorted({(self.ids[p[:k]] * n + self.ids[p[k:]], order[self.score[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids})
        self.pair, self.rank, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose blanks are written out."""
        score, symbols = self.score, list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def put(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(p := symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (s, i, j, p))

        for i in range(n - 1):
            put(i, i + 1)
        while agenda:
            _, i, j, p = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(p):
                continue
            symbols[i], symbols[j] = p, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            put(before[i], i)
            put(i, after[i])
        out = []
        for s in symbols:
            if s:
                own = self.ids.get(s)
                out += [own] if own is not None else [self.bytes[b] for b in s.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, with all its blanks; a run of byte pieces is read as UTF-8, what isn't is U+FFFD byte by byte."""
        parts, run = [], bytearray()
        for i in ids:
            if i in self.raw:
                run += self.text[i]
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run = bytearray()
            if i in self.text:
                parts.append(self.text[i].decode())
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts)

    def split(self, text: str) -> list[str]:
        """Words of a text. Each stands for itself with one blank before it; further blanks are written out."""
        if not text:
            return []
        if self.by_word and BLANK not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        text = BLANK + text.replace(" ", BLANK)
        return [w[1:] for w in re.findall(f"{BLANK}+[^{BLANK}]*", text)] if self.by_word else [text[1:]]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair on the agenda (NONE: makes no piece) and the piece it makes."""
        key = np.where((left >= 0) & (right >= 0), left * len(self.digits) + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """``encode`` of each word with its blank: the words' agendas are worked off in step, one merge of each word a round."""
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= KEPT_CHARS]
        for i in set(range(len(words))) - set(short):
            out[i] = self.encode(BLANK + words[i])
        if not short:
            return out
        text = [BLANK + words[i] for i in short]
        symbol = self.char[np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)]
        size = np.array([len(t) for t in text])
        word = np.array(short)
        tail = np.ones(len(symbol), bool)
        tail[:-1] = np.repeat(np.arange(len(size)), size)[1:] != np.repeat(np.arange(len(size)), size)[:-1]
        rank, made = self._rank(symbol, np.roll(symbol, -1))
        rank[tail] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            ended = best >> 32 >= NONE
            if ended.any():
                gone = np.repeat(ended, size)
                done.append((word[ended], size[ended], symbol[gone]))
                symbol, rank, made, tail = symbol[~gone], rank[~gone], made[~gone], tail[~gone]
                word, size = word[~ended], size[~ended]
                continue
            at = best & 0xFFFFFFFF
            symbol[at] = made[at]
            tail[at] = tail[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, rank, made, tail = symbol[keep], rank[keep], made[keep], tail[keep]
            at = at - np.arange(len(at))
            size = size - 1
            first = at == np.cumsum(size) - size
            for i in (at[~tail[at]], at[~first] - 1):
                rank[i], made[i] = self._rank(symbol[i], symbol[i + 1])
            rank[at[tail[at]]] = NONE
        for own, sizes, symbols in done:
            flat, upto = symbols.tolist(), np.cumsum(sizes).tolist()
            for i, a, b in zip(own.tolist(), [0, *upto], upto, strict=False):
                out[i] = flat[a:b]
                if min(out[i]) < 0:
                    out[i] = [y for x in out[i] for y in ([x] if x >= 0 else [self.bytes[c] for c in chr(-1 - x).encode()])]
        return out

    def _check(self, words: list[str], ids: list[list[int]], back: list[str]) -> None:
        """The library, which writes a text's first blank itself, must give the same ids and texts."""
        plain = [i for i, w in enumerate(words) if w and BLANK not in w] if self.by_word else []
        rest = set(range(len(words))) - set(plain)
        texts = [[i] for i in rest if words[i]] + [plain[k : k + CHECKED] for k in range(0, len(plain), CHECKED)]
        for k in range(0, len(texts), 16):
            some = texts[k : k + 16]
            own = [[x for i in text for x in ids[i]] for text in some]
            if self.library.encode([" ".join([words[i] for i in text]) for text in some], num_threads=1) != own:
                raise ValueError("the agenda and the sentencepiece library encode a word differently")
            if self.library.decode(own, num_threads=1) != ["".join([back[i] for i in text])[1:] for text in some]:
                raise ValueError("the agenda and the sentencepiece library decode a word differently")

    def learn(self, texts: list[list[str]]) -> dict[str, tuple[str, int, str]]:
        """(ids, number, decoded) of all words of the texts. New words are checked against the library."""
        words = {w for own in texts for w in own}
        here = {w: v for w in words if (v := self.words.get(w) or self.older.get(w))}
        new = list(words - here.keys())
        ids = self.encode_words(new)
        text, raw, digits = self.piece, self.raw, self.digits
        back = [self.decode(i) if not raw.isdisjoint(i) else "".join([text[x] for x in i]) for i in ids]
        self._check(new, ids, back)
        here |= {w: (" ".join([digits[x] for x in i]), len(i), b) for w, i, b in zip(new, ids, back, strict=True)}
        # two generations: words that come again stay, others go
        self.words.update((w, v) for w, v in here.items() if len(w) <= KEPT_CHARS)
        if len(self.words) > KEPT_WORDS:
            self.words, self.older = {}, self.words
        return here


def _utf8(run: bytes) -> str:
    """UTF-8 text of the bytes; each byte that is no part of a character gives U+FFFD."""
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as e:
            out += [run[: e.start].decode(), "�"]
            run = run[e.start + 1 :]
    return "".join(out)


_MODELS: dict[str, Pieces] = {}


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for each row of ``docs(doc_id, text)``.

    ``ids`` are decimal, joined by one space, with the end id last; ``decoded`` is the text they give back. ``path`` is the
    vocabulary file on each worker. Null texts are empty: the end id alone. Repeated rows and null doc_ids stay, further
    columns are ignored, an empty table gives an empty table. A long text is handled whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(path) or _MODELS.setdefault(path, Pieces(path))
        for batch in batches:
            all_texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in blocks([len(t) for t in all_texts], 1 << 21):
                texts = [model.split(t) for t in all_texts[a:b]]
                known = model.learn(texts)
                rows = [[known[w] for w in words] for words in texts]
                ids = [" ".join([*(r[0] for r in row), str(model.end)]) for row in rows]
                counts = [sum(r[1] for r in row) + 1 for row in rows]
                decoded = ["".join([r[2] for r in row])[1:] for row in rows]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids string, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", sha256_hex(F.col("ids")).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
