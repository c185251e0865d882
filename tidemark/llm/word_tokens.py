"""Token ids of whole texts with the tokenizers library, inside tasks.

A vocabulary file is read first: only if its normaliser, pre-tokenizer and model are the ones that the
shortcut below assumes (`takes_chunks`) is it taken; with any other, whole texts go to the library.

The pre-tokenizer drops white space and no rule of it looks across a blank, so a
text is cut at blanks and line feeds, each distinct chunk is encoded once, and a bounded memo of
chunks serves the rest of the task (and of later tasks in the same worker). Texts in Latin-1 are
lower-cased first, as the vocabulary's normaliser does, and cut before a full stop or comma that
ends a word too, which halves the distinct chunks. A new chunk that is a Latin word, with or
without ASCII punctuation behind it, is put together from its lower-cased word and its tail, each a
pre-token of its own; new words are encoded many to a call and told apart by the vocabulary's
end-of-word tokens.

Defined cases: the empty text has no ids; null is the caller's to replace; equal texts have equal ids.
"""

from __future__ import annotations

import json
import os
import re
from string import punctuation

import numpy as np

from .common import KEPT, release

#: Chunks that a worker remembers at most, in each of two generations; those met again move to the younger.
MEMO_LIMIT = 300_000
#: Words in a call.
JOINED = 512
#: Not a letter, digit or blank, before a full stop or comma that was cut off: they may be one pre-token.
RUN = re.compile(r"[^a-z0-9ß-öø-ÿ ] [.,]")

# Fixed rules of the vocabularies for which chunks give the ids of the whole text: normaliser, pre-tokenizer, model.
SHAPES = (
    [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    ],
)

_encoders: dict[str, "ChunkEncoder"] = {}
KEPT.append(_encoders.clear)


def chunks_of(text: str) -> list[str]:
    """Parts of a text whose ids, one after the other, are the ids of the text."""
    text = text.replace("\n", " ")
    if "<|" in text:  # lower case could make a special token of other letters
        return text.split(" ")
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
    text = text.lower()
    cut = text.replace(". ", " . ").replace(", ", " , ")
    return (text if RUN.search(cut) else cut).split(" ")


def takes_chunks(path: str) -> bool:
    """Whether the file's rules are those that cutting texts into lower-cased chunks relies on: see SHAPES."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    if rules.get("truncation") or rules.get("padding") or any(not t["content"].startswith("<|") or " " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules.get("added_tokens", [])):
        return False
    return [rules.get("normalizer"), rules.get("pre_tokenizer"), {k: v for k, v in rules["model"].items() if k not in ("vocab", "merges")}] in SHAPES


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole_texts = not takes_chunks(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def encode_chunks(self, chunks: list[str]) -> None:
        """Put chunks into the memo, each as the library encodes it."""
        for encoding, chunk in zip(self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), chunks, strict=True):
            self.memo[chunk] = np.array(encoding.ids, self.dtype).tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Put lower-case Latin words into the memo."""
        parts = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for part, encoding in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # a vocabulary without such tokens
                self.encode_chunks(part)
                continue
            data, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for word, cut in zip(part, (cuts * width).tolist(), strict=True):
                self.memo[word] = data[start:cut]
                start = cut

    def learn(self, new: list[str]) -> None:
        memo, made, odd = self.memo, [], []
        plain = {c for c in new if c.isascii() and c.isalpha() and c.islower()}
        for chunk in new:
            if chunk in plain:
                continue
            word = chunk.rstrip(punctuation)
            # up to U+017F letters are whole after normalising; the dotted capital I is not
            if word.isalpha() and max(word) <= "\u017f" and "\u0130" not in word:
                made.append((chunk, word.lower(), chunk[len(word) :]))
            else:
                odd.append(chunk)
        self.encode_chunks([*odd, *{t for _, _, t in made if t}.difference(memo, odd)])
        self.encode_words([*plain.union(w for _, w, _ in made).difference(memo)])
        for chunk, word, tail in made:
            memo[chunk] = memo[word] + memo[tail] if tail else memo[word]

    def rest(self) -> None:
        """Drop the older generation when a task ends: idle workers keep memory that other stages need."""
        self.older = {}
        release(kept=False)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as add_special_tokens=False gives them."""
        if self.whole_texts:
            return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 256):
            parts = [chunks_of(t) for t in texts[at : at + 256]]
            wanted = set().union(*parts) if parts else set()
            new = list(wanted.difference(self.memo))
            if len(self.memo) + len(new) > MEMO_LIMIT:
                self.memo, self.older, new = {}, self.memo, list(wanted)
            again = self.older.keys() & new
            self.memo.update((chunk, self.older[chunk]) for chunk in again)
            self.learn([chunk for chunk in new if chunk not in again])
            get = self.memo.__getitem__
            out += [np.frombuffer(b"".join(map(get, p)), self.dtype) for p in parts]
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
