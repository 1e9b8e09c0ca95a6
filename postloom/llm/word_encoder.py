"""Token ids of white-space separated words, remembered between batches of a task.

A tokenizer of the form ``BY_WORDS`` drops white space and no token crosses it, so the
ids of a text are the ids of its words in order.  Any other tokenizer gets whole
texts, uncut.  Distinct words are therefore encoded once per
task, in batches, by the ``tokenizers`` library.  Words of ASCII and Latin-1
letters are already in normal form; for them the library's BPE model is called on
the pieces that its pattern gives.  All other words go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The normaliser and splitter of the tokenizer whose words can be encoded one by one, as its file states them.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """``table(words)`` maps each word to ``form(ids)``, where form(a + b) = form(a) + form(b).

    Words are kept in two generations of at most ``max_words``: when the young one is
    full it becomes the old one, and words that are met again move back.
    """

    def __init__(self, path: str, form: Callable[[list[int]], object], max_words: int = 250_000, batch: int = 8192):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.form, self.by_words = form, False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            piece = SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: piece.encode(texts, num_threads=1)
            return
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.whole = lambda texts: [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.by_words = all(stated.get(k) == v for k, v in BY_WORDS.items())
        self.model = self.full.model
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.max_words, self.batch = max_words, batch
        self.known: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.pieces: dict[bytes, object] = {}

    def forget(self) -> None:
        """Let all words go: a worker lives on after a task, and what it holds then is missing to later stages."""
        if self.by_words:
            self.known, self.old, self.pieces = {}, {}, {}

    def units(self, text: bytes) -> list[bytes]:
        """What is encoded on its own: words, or the text."""
        return text.split() if self.by_words else [text]

    def piece_bytes(self, size: int) -> int:
        """``size`` where texts may be cut at white space, else more than any text has."""
        return size if self.by_words else 1 << 62

    def table(self, words: set[bytes]) -> dict[bytes, object]:
        """A mapping that has at least ``words``, units of texts."""
        if not self.by_words:
            texts = list(words)
            return dict(zip(texts, map(self.form, self.whole([t.decode() for t in texts])), strict=True))
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.max_words and self.known:
            self.known, self.old, new = {}, self.known, words
        back = new & self.old.keys()
        self.known.update((w, self.old[w]) for w in back)
        new = list(new - back)
        for at in range(0, len(new), self.batch):
            part = new[at : at + self.batch]
            self.known.update(zip(part, self.encode(part), strict=True))
        return self.known

    def encode(self, words: Iterable[bytes]) -> list[object]:
        split, rest = [], []
        for w in words:
            stem = w.rstrip(b".,")
            if stem.isalpha():  # ASCII letters only
                split.append((stem.lower(), w[len(stem) :]))
                continue
            t = w.decode()
            if PLAIN.fullmatch(t) and "<|" not in t:
                split.append([p.encode() for p in PIECES.findall(t.lower())])
            else:
                split.append(None)
                rest.append(t)
        whole = iter(self.full.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        asked = {p for parts in split if parts for p in parts}
        if len(self.pieces) + len(asked) > self.max_words:
            self.pieces = {}
        self.learn(asked - self.pieces.keys())
        of, form, out = self.pieces, self.form, []
        for parts in split:
            if parts is None:
                out.append(form(next(whole).ids))
            elif len(parts) == 2:
                out.append(of[parts[0]] + of[parts[1]])
            else:
                x = of[parts[0]]
                for p in parts[1:]:
                    x = x + of[p]
                out.append(x)
        return out

    def learn(self, pieces: set[bytes]) -> None:
        self.pieces.setdefault(b"", self.form([]))
        tokenize, form = self.model.tokenize, self.form
        self.pieces.update((p, form([t.id for t in tokenize(p.decode())])) for p in pieces if p and p.isascii())
        other = [p for p in pieces if not p.isascii()]
        if other:
            self.pieces.update((p, form(e.ids)) for p, e in zip(other, self.bare.encode_batch_fast([p.decode() for p in other], add_special_tokens=False), strict=True))


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, form: Callable[[list[int]], object]) -> WordEncoder:
    """This worker's encoder for the file and form."""
    key = (path, form.__name__)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, form)
    return _encoders[key]
