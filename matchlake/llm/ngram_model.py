"""Modified Kneser-Ney model of character classes, in sorted hash arrays.

Texts are folded to ``2**CLASS_BITS`` character classes, so a gram of ``ORDER``
classes is one of ``2**20`` codes whatever the corpus: a model has at most that
many entries per order and language, and may be sent to every task.
"""

from __future__ import annotations

import numpy as np

from matchlake.llm.hashing import mix

CLASS_BITS = 5
ORDER = 4
CODES = 1 << (CLASS_BITS * ORDER)
_SKIP = 255


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte: 0 white space, 1-26 letters, 27 and 28 characters beyond ASCII, 29 digits,
    30 punctuation, 31 other ASCII; bytes after the first of a character are skipped."""
    table = np.full(256, 31, dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[48:58] = 29
    table[list(b".,;:!?'\"()-")] = 30
    table[0x80:0xC0] = _SKIP
    table[0xC0:0xCA] = 27
    table[0xCA:] = 28
    return table


_TABLE = _classes()

# Nats to tell the ASCII characters of a class apart, all as likely: else a run of any digits or signs is one of a
# single character. White space and the case of letters are folded, and characters beyond ASCII are not told apart.
CLASS_NATS = np.zeros(1 << CLASS_BITS, dtype=np.float32)
CLASS_NATS[29:] = np.log(np.bincount(_TABLE[:128], minlength=1 << CLASS_BITS)[29:32])


def codes(text: bytes) -> np.ndarray:
    """Code of the gram that ends at each character; the text is led by ``ORDER - 1`` spaces."""
    kinds = _TABLE[np.frombuffer(b" " * (ORDER - 1) + text, dtype=np.uint8)]
    kinds = kinds[kinds != _SKIP].astype(np.int32)
    count = len(kinds) - ORDER + 1
    out = np.zeros(max(count, 0), dtype=np.int32)
    for k in range(ORDER):
        out = (out << CLASS_BITS) | kinds[k : k + len(out)]
    return out


def _key(order: int, gram: np.ndarray) -> np.ndarray:
    return mix((np.uint64(order) << np.uint64(32)) | gram.astype(np.uint64))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of each count, by modified Kneser-Ney: one for 1, one for 2, one for 3 and more."""
    n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    out = np.zeros(len(counts))
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0
            out[(counts == k) if k < 3 else (counts >= 3)] = min(max(d, 0.0), k)
    else:
        # Too few rare grams to estimate from: half a count.
        out[:] = 0.5
    return out


class KneserNey:
    """Log probabilities and back-off weights, looked up by hash in sorted arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """``grams``: distinct codes of ``ORDER`` classes; ``counts``: how often each was seen."""
        width = np.uint32(CLASS_BITS)
        levels = [(grams.astype(np.int64), counts.astype(np.int64))]
        for order in range(ORDER - 1, 0, -1):
            # Lower orders count the distinct classes before a gram.
            shorter = levels[-1][0] & ((1 << (CLASS_BITS * order)) - 1)
            levels.append(np.unique(shorter, return_counts=True))
        lower = {0: 1.0 / (1 << CLASS_BITS)}
        keys, logs, back_keys, backs = [], [], [], []
        probability: dict[int, float] | np.ndarray = np.full(1, lower[0])
        for order in range(1, ORDER + 1):
            gram, count = levels[ORDER - order]
            context = gram >> int(width)
            heads, inside = np.unique(context, return_inverse=True)
            total = np.bincount(inside, weights=count)
            discount = _discounts(count)
            left = np.bincount(inside, weights=discount) / total
            tail = gram & ((1 << (CLASS_BITS * (order - 1))) - 1)
            p = (count - discount) / total[inside] + left[inside] * probability[tail]
            probability = np.zeros(1 << (CLASS_BITS * order)) if order < ORDER else probability
            if order < ORDER:
                probability[gram] = p
            keys.append(_key(order, gram))
            logs.append(np.log(p))
            back_keys.append(_key(order - 1, heads))
            backs.append(np.log(np.maximum(left, 1e-12)))
        self.keys, self.logs = self._sorted(keys, logs)
        self.back_keys, self.backs = self._sorted(back_keys, backs)

    @staticmethod
    def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key)
        return key[order], value[order].astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of the last class of each gram after the others; unseen grams back off."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            gram = grams[open_].astype(np.int64) & ((1 << (CLASS_BITS * order)) - 1)
            known, value = self._find(self.keys, self.logs, _key(order, gram))
            out[open_[known]] += value[known]
            open_, gram = open_[~known], gram[~known]
            seen, weight = self._find(self.back_keys, self.backs, _key(order - 1, gram >> CLASS_BITS))
            out[open_[seen]] += weight[seen]
        out[open_] += np.log(1.0 / (1 << CLASS_BITS))
        return out
