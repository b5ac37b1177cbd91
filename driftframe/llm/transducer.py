"""BPE as an automaton that reads bytes, from the merge list's tables.

The state after a prefix is the last token of the prefix's encoding, for the prefix and those before it.  The next
byte's state follows by two tables: the tokens that end there (a trie of the tokens' bytes read backwards), and
whether such a token stays apart from the last token of the prefix it begins after.  Exactly one does.

Two tokens stay apart if no merge joins the touching parts of them while they are built; both are taken apart again
in reverse order of their merges, and each pair of touching parts is looked up in the merge list.

``lookahead`` is the merge list's sufficient lookahead: with so many bytes after its end, a token is stable.
:class:`Stream` reads one piece of any length and emits tokens once they are stable; ``Automaton.encode`` reads many
pieces at once, position by position in arrays, where a piece's end makes all its tokens stable.
"""

from __future__ import annotations

import numpy as np

NEVER = np.iinfo(np.int32).max
#: log2 of the remembered pairs.
PAIR_BITS = 20


class Automaton:
    """tokens: bytes by id; single: id of each byte; merges: (left id, right id, merged id) in order of rank."""

    def __init__(self, tokens: list[bytes], single: list[int], merges: list[tuple[int, int, int]]):
        self.bytes, self.single = tokens, single
        self.size = np.array([len(x) for x in tokens], np.int32)
        first: dict[tuple[int, int], int] = {}
        for rank, (left, right, _) in enumerate(merges):
            first.setdefault((left, right), rank)
        self.rank_of = first
        keys = np.array([left << 32 | right for left, right in first], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(first.values()), np.int32)[order]
        n = len(tokens)
        #: the merge that makes a token, by rank (-1: a single byte, NEVER: no encoding has it), and its two parts
        self.made = np.full(n, NEVER, np.int32)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.made[single] = -1
        self.need = np.zeros(n, np.int64)
        self._build(merges)
        self.lookahead = self._lookahead(merges)
        self._trie()
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_apart = np.zeros(1 << PAIR_BITS, bool)
        self.known: dict[int, bool] = {}

    def _build(self, merges: list[tuple[int, int, int]]) -> None:
        """A token is one if its parts are, and stay apart until their merge's turn."""
        triples = np.array(merges, np.int64).reshape(-1, 3)
        made = self.made.tolist()
        rank_of = self.rank_of
        for rank, (left, right, new) in enumerate(triples.tolist()):
            if made[new] == NEVER and made[left] != NEVER and made[right] != NEVER and rank_of[left, right] == rank:
                if max(made[left], made[right]) >= rank:
                    raise ValueError("a merge comes before those that make its parts")
                self.left[new], self.right[new], self.made[new] = left, right, rank
                made[new] = rank
        # all at once: whether the parts stay apart; a token whose parts don't, or have such parts, is none
        some = np.flatnonzero((self.made >= 0) & (self.made != NEVER))
        some = some[np.argsort(self.made[some])]
        good = self._apart(self.left[some], self.right[some], self.made[some])
        bad = set(some[~good].tolist())
        for token in some[good].tolist():
            if int(self.left[token]) in bad or int(self.right[token]) in bad:
                bad.add(token)
        if bad:
            for token in bad:  # another merge may make it
                self.made[token] = NEVER
            for rank, (left, right, new) in enumerate(triples.tolist()):
                if self.made[new] == NEVER and new in bad and self.made[left] != NEVER and self.made[right] != NEVER and rank_of[left, right] == rank and (self.left[new], self.right[new]) != (left, right):
                    if self._apart(np.array([left]), np.array([right]), np.array([rank]))[0]:
                        self.left[new], self.right[new], self.made[new] = left, right, rank

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def _apart(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge before a rank joins parts of two tokens that touch."""
        out = np.ones(len(left), bool)
        if not len(self.keys):
            return out
        rows = np.arange(len(left))
        a, b = left.astype(np.int32), right.astype(np.int32)
        a_ends = np.broadcast_to(np.asarray(until, np.int32), a.shape).copy()  # when the part becomes one of a larger one
        b_ends = a_ends.copy()
        made, right_of, left_of = self.made, self.right, self.left
        while len(rows):
            rank = self._rank(a, b)
            # of equal merges the leftmost comes first: that inside the left token before this one, this one before that in the right
            joined = (rank < a_ends) & ((rank < b_ends) | (rank == b_ends) & (b_ends != until))
            out[rows[joined]] = False
            from_a, from_b = made[a], made[b]
            go = ~joined & ((from_a >= 0) | (from_b >= 0))
            rows, a, b, a_ends, b_ends, from_a, from_b = (x[go] for x in (rows, a, b, a_ends, b_ends, from_a, from_b))
            if isinstance(until, np.ndarray):
                until = until[go]
            undo = from_a > from_b  # the last merge is undone; of equal ones the right one was last
            a_ends = np.where(undo, from_a, a_ends)
            b_ends = np.where(undo, b_ends, from_b)
            a, b = np.where(undo, right_of[a], a), np.where(undo, b, left_of[b])
        return out

    def _lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        """Bytes after a token's end that can decide whether it stands, at most.

        need of a token: the bytes after its end that can keep its own merges from happening.  Its last merge is kept
        from happening by an earlier merge of its right part with what follows, if that follows and that merge isn't
        itself kept from happening; and its right part needs what it needs.  Ranks fall along such a chain, so one
        pass by rank finds the longest.  A token that stands must not be joined with what follows by any merge."""
        longest: dict[int, int] = {}  # by left part: bytes of the right part and its merge's need
        need = self.need
        made, right_of = self.made, self.right
        for rank, (left, right, new) in enumerate(merges):
            if made[left] == NEVER or made[right] == NEVER or self.rank_of[left, right] != rank:
                continue
            own = max(longest.get(right, 0), int(need[right]))
            if made[new] == rank and right_of[new] == right:
                need[new] = own
            longest[left] = max(longest.get(left, 0), int(self.size[right]) + own)
        return max(1, *(max(longest.get(t, 0), int(need[t])) for t in {*self.single, *longest, *np.flatnonzero(self.made != NEVER).tolist()}))

    def _trie(self) -> None:
        """Nodes of the tokens' bytes read backwards: (node, byte) -> node, and the token of a node."""
        steps: dict[int, int] = {}
        token = [-1]
        for i in np.flatnonzero(self.made != NEVER).tolist():
            node = 0
            for b in reversed(self.bytes[i]):
                key = node << 8 | b
                child = steps.get(key)
                if child is None:
                    child = steps[key] = len(token)
                    token.append(-1)
                node = child
            token[node] = i
        self.steps = steps
        self.token = np.array(token, np.int32)
        self.token_list = token
        keys = np.fromiter(steps, np.int64, len(steps))
        order = np.argsort(keys)
        self.step_keys, self.step_nodes = keys[order], np.fromiter(steps.values(), np.int32, len(steps))[order]
        self.first_step = np.full(256, -1, np.int32)
        low = self.step_keys < 256
        self.first_step[self.step_keys[low]] = self.step_nodes[low]

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        wanted = node.astype(np.int64) << 8 | byte
        at = np.searchsorted(self.step_keys, wanted)
        at[at == len(self.step_keys)] = 0
        return np.where(self.step_keys[at] == wanted, self.step_nodes[at], -1)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_apart() with a bounded memory of pairs."""
        keys = left.astype(np.int64) << 32 | right
        place = ((keys * np.int64(0x2545F4914F6CDD1D)) >> np.int64(64 - PAIR_BITS)) & np.int64((1 << PAIR_BITS) - 1)
        out = self.pair_apart[place]
        new = np.flatnonzero(self.pair_keys[place] != keys)
        if len(new):
            unique, back = np.unique(keys[new], return_inverse=True)
            found = self._apart((unique >> 32).astype(np.int32), (unique & 0xFFFFFFFF).astype(np.int32))
            out[new] = found[back]
            place = place[new]
            self.pair_keys[place], self.pair_apart[place] = keys[new], out[new]
        return out

    def apart_one(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= 1 << PAIR_BITS - 2:
                self.known.clear()
            found = self.known[key] = bool(self._apart(np.array([left]), np.array([right]))[0])
        return found

    def encode(self, pieces: list[bytes], kind: str = "<i4") -> list[bytes]:
        """The ids of each piece, as bytes of a kind."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        if not len(pieces) or not sizes.sum():
            return [b""] * len(pieces)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        starts = np.cumsum(sizes) - sizes
        place = (np.arange(n) - np.repeat(starts, sizes)).astype(np.int32)  # of a byte in its piece
        # the tokens that end at each byte, inside its piece: by the bytes read backwards, all bytes at once
        ends, tokens = [], []
        at, node, back = np.arange(n), self.first_step[data], 1
        while len(at):
            token = self.token[node]
            some = token >= 0
            ends.append(at[some])
            tokens.append(token[some])
            more = place[at] >= back
            at, node = at[more], node[more]
            node = self._step(node, data[at - back])
            some = node >= 0
            at, node = at[some], node[some]
            back += 1
        end, token = np.concatenate(ends), np.concatenate(tokens)
        begin = end - self.size[token]
        # by place in the piece, so that the states before are known
        order = np.argsort(place[end], kind="stable")
        end, token, begin = end[order], token[order], begin[order]
        edges = np.searchsorted(place[end], np.arange(int(place.max()) + 2))
        state = np.empty(n, np.int32)
        for p in range(len(edges) - 1):
            part = slice(edges[p], edges[p + 1])
            e, t, b = end[part], token[part], begin[part]
            inside = place[e] + 1 > self.size[t]
            fits = ~inside  # the piece's first token
            fits[inside] = self.apart(state[b[inside]], t[inside])
            state[e[fits]] = t[fits]
        # the tokens of a piece from its end, in as many steps as the most tokens
        last = starts + sizes - 1
        rows = np.flatnonzero(sizes > 0)
        last = last[rows]
        taken, owner = [], []
        while len(rows):
            t = state[last]
            taken.append(t)
            owner.append(rows)
            last = last - self.size[t]
            more = last >= starts[rows]
            rows, last = rows[more], last[more]
        owner_all = np.concatenate(owner)[::-1]
        ids = np.concatenate(taken)[::-1]
        order = np.argsort(owner_all, kind="stable")
        ids = ids[order].astype(kind)
        width = ids.dtype.itemsize
        bounds = (np.searchsorted(owner_all[order], np.arange(len(pieces) + 1)) * width).tolist()
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class Stream:
    """One piece, byte by byte: holds the bytes and states that later bytes can still matter to."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.states: list[int] = []
        self.tail = bytearray()
        self.before = -1  # the last token emitted

    def feed(self, data: bytes) -> list[int]:
        a, out = self.a, []
        steps, token_of, size, states, tail = a.steps, a.token_list, a.size, self.states, self.tail
        limit = 2 * a.lookahead + 4096
        for b in data:
            tail.append(b)
            n = len(tail)
            node, chosen = 0, -1
            for back in range(1, n + 1):
                node = steps.get(node << 8 | tail[n - back], -1)
                if node < 0:
                    break
                token = token_of[node]
                if token >= 0:
                    before = states[n - back - 1] if back < n else self.before
                    if before < 0 or a.apart_one(before, token):
                        chosen = token
                        break
            states.append(chosen)
            if n >= limit:
                out += self._emit(n - a.lookahead)
                states, tail = self.states, self.tail
        return out

    def _emit(self, upto: int) -> list[int]:
        """The tokens of the encoding so far that end there or before."""
        out, n = [], len(self.tail)
        while n > 0:
            token = self.states[n - 1]
            if n <= upto:
                if not out:
                    end = n
                out.append(token)
            n -= len(self.a.bytes[token])
        if out:
            out.reverse()
            self.before = out[-1]
            del self.states[:end]
            del self.tail[:end]
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.tail))
