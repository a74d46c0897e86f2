"""Byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import unicodedata
from pyspark.sql import DataFrame

#: Entries of a worker's word and pair caches before they are emptied; memory stays bounded.
CACHE = 250_000


def byte_chars() -> dict[int, str]:
    """The printable character of each byte: itself where printable, else the next from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """A merge list with the look-ups of the transducer."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix = vocab, suffix
        self.rank = {pair: k for k, pair in enumerate(merges)}
        made = {a + b for a, b in merges}
        self.symbols = {t for t in vocab if t not in made}
        self.tokens = self.symbols | made
        self.width = max((self.n_symbols(t) for t in self.tokens), default=1)
        self._fits: dict[tuple[str, str], bool] = {}

    def n_symbols(self, token: str) -> int:
        ends = self.suffix and token.endswith(self.suffix)
        return max(1, len(token) - len(self.suffix) if ends else len(token))

    def split(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def lookahead(self) -> int:
        """Symbols behind the newest one after which no token can change any more.

        A token changes only when a symbol to its right takes part of it away, by a rule of
        higher priority whose left part ends it; that frees its left neighbour for a rule of
        lower priority, and so on. The longest such chain of rules, each of at most ``width``
        symbols, bounds the lookahead.
        """
        longest_from: dict[str, int] = {}
        longest = 1
        for a, b in sorted(self.rank, key=self.rank.get):
            parts = self.split(b)
            tails = ("".join(parts[k:]) for k in range(len(parts)))
            chain = 1 + max((longest_from.get(t, 0) for t in tails), default=0)
            longest_from[a] = max(longest_from.get(a, 0), chain)
            longest = max(longest, chain)
        return self.width * (longest + 1)

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge a short run by always taking the leftmost pair of best rank."""
        run = list(symbols)
        while len(run) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(run, run[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            k = ranks.index(best)
            run[k : k + 2] = [run[k] + run[k + 1]]
        return run

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            known = self._fits[key] = self.merged(self.split(left) + self.split(right) if left else self.split(right)) == (
                [left, right] if left else [right])
        return known


class Transducer:
    """Turns a stream of symbols into tokens.

    For every position the last token of the encoding so far is kept, with the place where it
    starts; encodings of longer inputs continue one of the last ``width`` positions. A token
    is emitted once all of these lie behind it. The kept positions never exceed the lookahead
    by more than one check interval, however long the input.
    """

    def __init__(self, merges: Merges, lookahead: int):
        self.m, self.keep = merges, lookahead

    def run(self, symbols: Iterable[str]) -> Iterator[str]:
        m = self.m
        width, tokens, fits, known = m.width, m.tokens, m.fits, m._fits
        recent: list[str] = []  # symbols since the last emitted token
        last: list[str] = [""]  # last[i]: last token of the encoding of recent[:i]
        size: list[int] = [0]  # its length in symbols
        left = ""  # the last emitted token
        next_check = self.keep + width
        for symbol in symbols:
            recent.append(symbol)
            n = len(recent)
            text = ""
            for k in range(1, min(width, n) + 1):
                text = recent[n - k] + text
                if text in tokens:
                    before = last[n - k] if k < n else left
                    fit = known.get((before, text))
                    if fit or (fit is None and fits(before, text)):
                        break
            else:
                raise ValueError(f"no token ends with {symbol!r}")
            last.append(text)
            size.append(k)
            if n >= next_check:
                done = self._common(size, n, width)
                if done:
                    out = self._path(last, size, done)
                    yield from out
                    left = out[-1]
                    recent, last, size = recent[done:], ["", *last[done + 1 :]], [0, *size[done + 1 :]]
                next_check = len(recent) + self.keep
        yield from self._path(last, size, len(recent))

    def short(self, symbols: list[str]) -> list[str]:
        """What ``run`` gives for symbols fewer than its first check, whose positions are all kept."""
        m = self.m
        width, tokens, fits, known = m.width, m.tokens, m.fits, m._fits
        last, size = [""], [0]
        for n in range(1, len(symbols) + 1):
            text = ""
            for k in range(1, min(width, n) + 1):
                text = symbols[n - k] + text
                if text in tokens:
                    pair = (last[n - k], text)
                    fit = known.get(pair)
                    if fit or (fit is None and fits(*pair)):
                        break
            else:
                raise ValueError(f"no token ends with {symbols[n - 1]!r}")
            last.append(text)
            size.append(k)
        return self._path(last, size, len(symbols))

    @staticmethod
    def _path(last: list[str], size: list[int], at: int) -> list[str]:
        out = []
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    @staticmethod
    def _common(size: list[int], n: int, width: int) -> int:
        """The last token end that the encodings of all live positions share."""
        live = set(range(max(0, n - width + 1), n + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - size[top])
        return live.pop()


class Encoder:
    """Text to ids, with the normal form, word pattern and special strings of a tokenizer file."""

    PIECE = 1 << 16

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.m = Merges(model["vocab"], [tuple(x) for x in model["merges"]], model["end_of_word_suffix"] or "")
        self.transducer = Transducer(self.m, self.m.lookahead())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.chars = byte_chars()
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.cache: dict[str, list[int]] = {}

    def forget(self) -> None:
        """Words go with their task; which tokens fit is the merge list's and stays, within ``CACHE``."""
        self.cache.clear()

    def _symbols(self, word: str) -> Iterator[str]:
        held = None
        for c in word:
            for b in c.encode("utf-8"):
                if held is not None:
                    yield held
                held = self.chars[b]
        yield held + self.m.suffix

    def _word(self, word: str) -> Iterator[int]:
        ids = self.m.ids
        return (ids[t] for t in self.transducer.run(self._symbols(word)))

    def _pieces(self, text: str) -> Iterator[str]:
        """Pieces that end before ASCII white space, which no composed character or word spans."""
        at = 0
        while at < len(text):
            end = at + self.PIECE
            while end < len(text) and text[end] not in " \t\n\r\x0b\x0c":
                end += 1
            yield text[at:end]
            at = end

    def _plain(self, text: str) -> Iterator[list[int] | Iterator[int]]:
        cache = self.cache
        for piece in self._pieces(text):
            # each character is lowered on its own: a final sigma is no special case
            normal = unicodedata.normalize("NFC", piece)
            normal = "σ".join(p.lower() for p in normal.split("Σ")) if "Σ" in normal else normal.lower()
            words = self.word.findall(normal)
            runs = list(map(cache.get, words))
            start = 0
            if None in runs:
                for k, word in enumerate(words):
                    if runs[k] is not None:
                        continue
                    if len(word) > 256:
                        yield list(chain.from_iterable(runs[start:k]))
                        yield self._word(word)
                        start = k + 1
                        continue
                    ids = cache.get(word)  # the piece may hold it twice
                    if ids is None:
                        if len(cache) > CACHE:
                            cache.clear()
                        symbols = list(map(self.chars.__getitem__, word.encode("utf-8")))
                        symbols[-1] += self.m.suffix
                        # so few symbols are kept whole, as the stream keeps them
                        made = self.transducer.short(symbols) if len(symbols) < self.transducer.keep else self.transducer.run(symbols)
                        ids = cache[word] = [self.m.ids[t] for t in made]
                    runs[k] = ids
            yield list(chain.from_iterable(runs[start:]))

    def encode(self, text: str) -> Iterator[list[int] | Iterator[int]]:
        """Runs of ids; a special string in the text is its own id."""
        at = 0
        for hit in self.cut.finditer(text):
            yield from self._plain(text[at : hit.start()])
            yield [self.special[hit[0]]]
            at = hit.end()
        yield from self._plain(text[at:] if at else text)


class Decoder:
    """Ids to text, one at a time.

    ``joined``: the tokens' own characters with a space between them, as a tokenizer file
    without a decoder gives. Otherwise characters go back to bytes, a word end becomes a
    space, and bytes that do not yet end a character wait for the next token.
    """

    def __init__(self, encoder: Encoder, joined: bool = True):
        self.text, self.suffix, self.special = encoder.text, encoder.m.suffix, set(encoder.special.values())
        self.bytes = {c: b for b, c in encoder.chars.items()}
        self.joined, self.first = joined, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        token = self.text[token_id]
        if self.joined:
            out, self.first = token if self.first else " " + token, False
            return out
        if token_id in self.special:
            return self.utf8.decode(b"", True) + token
        ends = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if ends else token
        return self.utf8.decode(bytes(self.bytes[c] for c in body), ends) + " " * ends

    def feed_all(self, ids: list[int]) -> str:
        if not self.joined or not ids:
            return "".join(map(self.feed, ids))
        lead, self.first = "" if self.first else " ", False
        return lead + " ".join(map(self.text.__getitem__, ids))

    def close(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker, not for each task."""
    return Encoder(path)


def _digests(enc: Encoder, text: str, with_ids: bool, block: int = 1 << 14) -> tuple[int, str, str, bytes]:
    """Token count, digests of ids and decoded text, and the ids' bytes if asked for; held a block at a time."""
    ids_sha, text_sha, n, out, buf = hashlib.sha256(), hashlib.sha256(), 0, [], []
    decoder = Decoder(enc)

    def flush():
        raw = np.array(buf, dtype="<u4").tobytes()
        ids_sha.update(raw)
        if with_ids:
            out.append(raw)
        text_sha.update(decoder.feed_all(buf).encode())
        buf.clear()

    for run in enc.encode(text):
        if isinstance(run, list):
            buf.extend(run)
        else:  # a long word is a stream
            for i in run:
                buf.append(i)
                if len(buf) >= block:
                    n += len(buf)
                    flush()
        if len(buf) >= block:
            n += len(buf)
            flush()
    n += len(buf)
    flush()
    return n, ids_sha.hexdigest(), text_sha.hexdigest(), b"".join(out)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids as an array if asked for.

    ``path`` names the tokenizer file, which each worker has. A null text is encoded as an
    empty one: no tokens and the digests of nothing. Repeated rows give repeated results, an
    empty table an empty result; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        try:
            for whole in batches:
                for k in range(0, len(whole), 128):
                    b = whole.iloc[k : k + 128]
                    rows = [_digests(enc, t if isinstance(t, str) else "", with_ids) for t in b["text"]]
                    out = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": [r[0] for r in rows],
                                        "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})
                    if with_ids:
                        out["ids"] = [np.frombuffer(r[3], "<u4").astype(np.int64) for r in rows]
                    yield out
        finally:  # the worker lives on, its caches need not
            enc.forget()

    return docs.select("doc_id", "text").mapInPandas(encode, schema)
