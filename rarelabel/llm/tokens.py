"""Token ids and counts of two public tokenizers; both classes live in Python workers, once per process."""

from __future__ import annotations

import functools
import re
import struct

MEMO_ENTRIES = 200_000  # per worker process; the table is emptied when full
SPACE = "▁"
PROBES = 1_000


class PieceCounter:
    """Token counts of a sentencepiece BPE model.

    Shortcut, proved when the model is loaded: ``whole`` holds every vocabulary
    string of the form (space + word) that the library itself encodes as one
    token.  A pre-token found there counts as 1 without any merging.

    Pre-tokens are independent because, as ``__init__`` checks, the model does
    not change the text but for spaces, and no vocabulary string has a space
    after another character or a line feed next to one.  If a model fails the
    check, each text goes to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size) if not self.library.is_control(i) and not self.library.is_byte(i)]
        probe = "  AbÄﬁ  c "
        same_text = "".join(self.library.encode(probe, out_type=str)) == SPACE + probe.replace(" ", SPACE)
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.splits = same_text and cut
        self.line_feed_splits = not any("\n" in p for p in pieces)
        words = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]]
        encoded = self.library.encode(words, num_threads=1)
        self.whole = {w: 1 for w, ids in zip(words, encoded, strict=True) if len(ids) == 1}
        self.memo: dict[str, int] = {}

    def _unseen(self, words: list[str]) -> None:
        if len(self.memo) + len(words) > MEMO_ENTRIES:
            self.memo.clear()
        # "\n..." stands behind no space: the library's leading space is one token of its own
        for word, ids in zip(words, self.library.encode(words, num_threads=1), strict=True):
            self.memo[word] = len(ids) - (word[:1] == "\n")

    def _pre_tokens(self, text: str) -> list[str] | None:
        if not self.splits or "  " in text or text[:1] == " " or SPACE in text:
            return None
        return (text.replace("\n", " \n") if self.line_feed_splits else text).split(" ")

    def _count_whole(self, text: str) -> int:
        """For texts with runs of spaces: pre-tokens keep their run."""
        if not self.splits:
            return len(self.library.encode(text))
        segments = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        # the library adds one leading space itself, but not to an empty text
        return sum(len(ids) or 1 for ids in self.library.encode([s[1:] for s in segments], num_threads=1))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; 0 for null or empty."""
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            words = self._pre_tokens(text)
            if words is None:
                out.append(self._count_whole(text))
                continue
            whole, memo, total, rest = self.whole, self.memo, 0, []
            for w in words:
                n = whole.get(w) or memo.get(w)
                if n:
                    total += n
                elif w:
                    rest.append(w)
                else:
                    total += 1  # a space before a line feed or the end
            if rest:
                self._unseen(list(dict.fromkeys(rest)))
                total += sum(map(self.memo.__getitem__, rest))
            out.append(total)
        return out


#: Fixed value: how byte-level BPE of this kind cuts a text before merging.
_PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteIds:
    """Token ids of a byte-level BPE, as little-endian unsigned 32-bit bytes.

    The vocabulary is that of the ``tokenizers`` file at ``path``; its ids are in
    order of merging, so ``tiktoken`` merges by them, several times as fast, to
    the same ids.  That is checked on every vocabulary string when the model is
    loaded; if it fails, and for texts that hold a special string, the library
    encodes.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_of = _byte_of_character()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        probes = [t for b in ranks if (t := b.decode("utf-8", "ignore")) and t.encode() == b]
        self.same = all(self._agree(probes[k : k + PROBES]) for k in range(0, len(probes), PROBES))

    def _agree(self, probes: list[str]) -> bool:
        """Few probes at a time: the library's answers are large, and the worker would keep their memory."""
        expected = self.library.encode_batch(probes, add_special_tokens=False)
        return all(e.ids == self.fast.encode_ordinary(p) for p, e in zip(probes, expected, strict=True) if not any(s in p for s in self.special))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.same or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@functools.cache
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@functools.cache
def byte_ids(path: str) -> ByteIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteIds(path)
