"""Token ids by the tokenizers library, with a bounded memo of pieces."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

#: The pre-tokenizer pattern and normalisers for which pieces are independent of each other.
CHUNK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` has them.

    Where the vocabulary's rules cut texts into independent pieces (checked on its own settings) and a text is plain Latin,
    the pieces are cut here and each piece's ids are kept in a memo of about ``memo`` entries. Any other text (one with the
    literal of an added token, say), and any other vocabulary, goes through the library whole.
    """

    def __init__(self, path: str, memo: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        rules = json.loads(self.whole.to_str())
        steps = [s.get("pattern", {}).get("Regex", s["type"]) for s in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = [s.get("pattern", {}).get("Regex", s["type"]) for s in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_piece = steps == ["NFC", r"\s+", "Lowercase"] and cuts == [CHUNK_PATTERN, "ByteLevel"] and rules["model"].get("end_of_word_suffix") == "</w>"
        if self.by_piece:
            # below U+0250 there is nothing to compose; U+0130 grows when lower-cased; U+001C to U+001F are no white space to the library
            latin = [chr(i) for i in range(0x21, 0x250) if i != 0x130]
            letters, numbers = ("".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == k) for k in "LN")
            self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall
            self.latin = re.compile("[\t-\r\x20-\u012f\u0131-\u024f]*").fullmatch
            self.added = re.compile("|".join(re.escape(x["content"].lower()) for x in rules["added_tokens"]) or "(?!)").search
            self.limit, self.memo, self.letters = memo, {}, _byte_letters()
            rules["pre_tokenizer"], rules["normalizer"], rules["post_processor"] = {"type": "WhitespaceSplit"}, None, None
            self.plain = Tokenizer.from_str(json.dumps(rules))
            self.plain.encode_special_tokens = True
            self.ends = {i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")}

    def _whole(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> None:
        texts = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        for i in range(0, len(words), 256):
            ids = self.plain.encode(" ".join(texts[i : i + 256]), add_special_tokens=False).ids
            packed, ends = struct.pack(f"<{len(ids)}I", *ids), self.ends
            at, k = 0, i
            for n, x in enumerate(ids, 1):
                if x in ends:
                    self.memo[words[k]] = packed[at : 4 * n]
                    at, k = 4 * n, k + 1

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            return [self._whole(t or "") for t in texts]
        out = []
        for i in range(0, len(texts), 32):
            lower = [t.lower() if t and self.latin(t) else None for t in texts[i : i + 32]]
            some = [self.cut(t) if t and not self.added(t) else None for t in lower]
            miss = set().union(*(p for p in some if p)).difference(self.memo)
            if miss:
                if len(self.memo) > self.limit:
                    self.memo.clear()
                    miss = set().union(*(p for p in some if p))
                self._learn(list(miss))
            get = self.memo.__getitem__
            out += [b"".join(map(get, p)) if p is not None else self._whole(t or "") for p, t in zip(some, texts[i : i + 32], strict=True)]
        return out
