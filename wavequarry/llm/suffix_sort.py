"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

_WORD = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


class BlindTrie:
    """Strings as leaves; an inner node has only the depth where its strings part and the byte that leads to each child.

    A string is looked up by branching bytes alone, then compared once, with the
    leaf that the look-up reached, to find where it belongs. ``end`` branches
    stand before all bytes, as a string that ends stands before its extensions.
    """

    _END = -1

    def __init__(self, strings: list[bytes]):
        self._strings = strings
        self._root: list | int | None = None

    def add(self, k: int) -> None:
        s = self._strings[k]
        if self._root is None:
            self._root = [len(s) + 1, {}, [k]]
            return
        node = self._root
        while node[1]:
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self._strings[node[2][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[2].append(k)
            return
        above, node = None, self._root
        while node[1] and node[0] < depth:
            above, node = node, node[1][self._byte(s, node[0])]
        leaf = [len(s) + 1, {}, [k]]
        if node[1] and node[0] == depth:
            node[1][self._byte(s, depth)] = leaf
            return
        inner = [depth, {self._byte(s, depth): leaf, self._byte(other, depth): node}, []]
        if above is None:
            self._root = inner
        else:
            above[1][self._byte(s, above[0])] = inner

    def _byte(self, s: bytes, at: int) -> int:
        return s[at] if at < len(s) else self._END

    def in_order(self) -> list[int]:
        out, todo = [], [self._root] if self._root is not None else []
        while todo:
            node = todo.pop()
            if node[1]:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node[2]
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = 64, start: int = 0) -> list[int]:
    """The order of ``strings``, all equal before ``start``; ties by place.

    Multikey quicksort parts them by eight bytes at a time down to ``start + shallow``;
    what is still equal there is ordered by a blind trie.
    """
    out: list[int] = []
    todo = [(list(range(len(strings))), start)]
    while todo:
        own, depth = todo.pop()
        if len(own) < 2:
            out += own
            continue
        if depth >= start + shallow:
            trie = BlindTrie(strings)
            for k in own:
                trie.add(k)
            out += trie.in_order()
            continue
        stop = depth + _WORD
        keys = [strings[k][depth:stop] for k in own]
        a, b, c = keys[0], keys[len(keys) // 2], keys[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        low = [k for k, x in zip(own, keys, strict=True) if x < pivot]
        same = [k for k, x in zip(own, keys, strict=True) if x == pivot]
        high = [k for k, x in zip(own, keys, strict=True) if x > pivot]
        if high:
            todo.append((high, depth))
        if len(pivot) < _WORD:  # these have ended, and are equal
            todo += [([k], depth) for k in reversed(same)]
        else:
            todo.append((same, stop))
        if low:
            todo.append((low, depth))
    return out
