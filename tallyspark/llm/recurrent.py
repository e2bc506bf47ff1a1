"""A gated recurrent network over word sequences with a class-factored output softmax, in numpy: truncated backpropagation, many texts at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANES, WINDOW = 512, 32
#: Scoring carries its state exactly, so its windows may be longer than the training's where few texts are left.
CELLS = 4096


@dataclass(frozen=True)
class Vocabulary:
    """How a token's number (its input) maps to its class and to its place among the class's members.

    Tokens below `single` are classes of their own. The others are members of the classes from `single` on: class `single + k` has the tokens
    `single + edges[k]` up to `single + edges[k + 1]`.
    """

    single: int
    edges: np.ndarray

    @property
    def tokens(self) -> int:
        return self.single + int(self.edges[-1])

    @property
    def classes(self) -> int:
        return self.single + len(self.edges) - 1

    def class_of(self) -> np.ndarray:
        return np.concatenate([np.arange(self.single), self.single + np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))]).astype(np.uint16)


#: Logits whose absolute values stay below this need no shift before exp in float32.
SAFE = 60.0


def _softmax(logits: np.ndarray, safe: bool) -> np.ndarray:
    """exp of the logits in place, each row shifted by its greatest value unless that is known to be needless; the rows' sums."""
    if not safe:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


def _log_shares(logits: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """The logarithm of each row's softmax at one place."""
    if not safe:
        logits -= logits.max(1, keepdims=True)
    hit = logits[np.arange(len(logits)), at]
    np.exp(logits, out=logits)
    return hit - np.log(logits @ np.ones(logits.shape[1], np.float32))


class Room:
    """Memory for a window's large arrays, used again by the next window: fresh pages cost a fifth of a window's time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.held or self.held[name].size < n:
            self.held[name] = np.empty(n, np.float32)
        return self.held[name][:n].reshape(shape)


@dataclass
class Network:
    """embed: a vector for each token; given: its share of the three gates; hidden: the state's share; out: from the state (and 1) to the classes; member: to each class's tokens."""

    embed: np.ndarray  # tokens x e
    given: np.ndarray  # e x 3h: update, reset, candidate
    hidden: np.ndarray  # h x 3h
    out: np.ndarray  # h + 1 x classes
    member: np.ndarray  # tokens - single x h + 1
    vocabulary: Vocabulary

    @classmethod
    def new(cls, counts: np.ndarray, vocabulary: Vocabulary, size: int, seed: int = 7) -> Network:
        """Begins as the classes' shares and the tokens' shares of them alone. counts: of each token."""
        rng, kinds = np.random.default_rng(seed), vocabulary.class_of()
        scaled = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        by_class = np.bincount(kinds, counts, vocabulary.classes)
        out = np.zeros((size + 1, vocabulary.classes), np.float32)
        out[size] = np.log(np.maximum(by_class / max(1.0, by_class.sum()), 1e-7))
        member = np.zeros((vocabulary.tokens - vocabulary.single, size + 1), np.float32)
        own = counts[vocabulary.single :]
        member[:, size] = np.log(np.maximum(own / np.maximum(by_class[kinds[vocabulary.single :]], 1), 1e-7))
        return cls(scaled(vocabulary.tokens, size), scaled(size, 3 * size), scaled(size, 3 * size), out, member, vocabulary)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.given, self.hidden, self.out, self.member]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def like(self, flat: np.ndarray) -> Network:
        """A network of this shape with other weights."""
        made, at = [], 0
        for x in self.arrays():
            made.append(np.array(flat[at : at + x.size], np.float32).reshape(x.shape))
            at += x.size
        return Network(*made, self.vocabulary)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        """Something with the three gates side by side as one block for each gate, so that a gate's numbers lie together; the first two are negated, as sigmoids need them."""
        out = np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))
        np.negative(out[:2], out=out[:2])
        return out

    def forward(self, inputs: np.ndarray, state: np.ndarray, table: np.ndarray, keep: bool, room: Room | None = None) -> tuple[np.ndarray, list]:
        """States after each step of a window (time x lanes x h), and what backpropagation needs. table: embed @ given, or its blocks."""
        states, kept, hidden = np.empty((len(inputs), *state.shape), np.float32), [], self.blocks(self.hidden)
        table = self.blocks(table) if table.ndim == 2 else table
        given = (room or Room()).of("given", 3, *states.shape)
        np.take(table, inputs, axis=1, out=given, mode="clip")
        for t in range(len(inputs)):
            through = state @ hidden
            gates = given[:2, t] + through[:2]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates
            c = r * through[2]
            c += given[2, t]
            np.tanh(c, out=c)
            new = c - state
            if keep:
                kept.append((z, r, c, through[2], new))
                np.multiply(z, new, out=states[t])
                states[t] += state
            else:
                new *= z
                np.add(new, state, out=states[t])
            state = states[t]
        return states, kept

    def safe(self) -> bool:
        """Whether no state can lead to large logits: a state's values lie between -1 and 1, so the weights bound them."""
        return max(float(np.abs(self.out).sum(0).max()), float(np.abs(self.member).sum(1).max(initial=0))) < SAFE

    def joint(self, states: np.ndarray) -> np.ndarray:
        """States with a 1, for the biases."""
        flat = states.reshape(-1, states.shape[-1])
        out = np.ones((len(flat), flat.shape[1] + 1), np.float32)
        out[:, :-1] = flat
        return out

    def members(self, kinds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The rows whose classes have several members, class by class, and for each such class its rows (from, to) and members (from, to)."""
        order = np.argsort(kinds, kind="stable")
        first = np.searchsorted(kinds[order], np.arange(self.vocabulary.single, self.vocabulary.classes + 1)).tolist()
        edges = self.vocabulary.edges.tolist()
        return order, [(a, b, x, y) for a, b, x, y in zip(first, first[1:], edges, edges[1:]) if b > a and y - x > 1]

    def train(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, state: np.ndarray, kinds: np.ndarray, room: Room | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of a window's mean log loss, and the state to carry on. kinds: the class of each token."""
        room = room or Room()
        used, at = np.unique(inputs, return_inverse=True) if inputs.size < len(self.embed) else (slice(None), inputs)
        states, kept = self.forward(at, state, self.embed[used] @ self.given, True, room)
        target, h = targets.ravel(), state.shape[1]
        own, safe = kinds[target], self.safe()
        order, segments = self.members(own)
        # from here to d_states all rows are class by class, so that each class's rows lie together
        joint, own, place = self.joint(states).take(order, axis=0), own[order], (target.astype(np.int64) - self.vocabulary.single)[order]
        weight = (live.ravel()[order] / max(1.0, float(live.sum()))).astype(np.float32)
        p = np.matmul(joint, self.out, out=room.of("classes", len(joint), self.out.shape[1]))
        total = _softmax(p, safe)
        p[np.arange(len(p)), own] -= total
        # the rows of p lack the factor 1 / total and the mean's weight; these go to the narrow sides of the products
        row = (weight / total)[:, None]
        d_out, d_joint, d_member = (joint * row).T @ p, (p @ self.out.T) * row, np.zeros_like(self.member)
        for a, b, x, y in segments:
            side, block = joint[a:b], self.member[x:y]
            q = side @ block.T
            sums = _softmax(q, safe)
            q[np.arange(b - a), place[a:b] - x] -= sums
            scale = (weight[a:b] / sums)[:, None]
            np.matmul(q.T, side * scale, out=d_member[x:y])
            d_joint[a:b] += (q @ block) * scale
        d_states = np.empty_like(states)
        d_states.reshape(-1, h)[order] = d_joint[:, :h]
        carry, d_given, d_through = np.zeros_like(state), room.of("gates", 3, *states.shape), np.empty_like(states)
        back = np.ascontiguousarray(self.hidden.T).reshape(3, h, h)
        for t in range(len(inputs) - 1, -1, -1):
            z, r, c, through, moved = kept[t]
            d = d_states[t] + carry
            dz = d * z
            g_z, g_r, d_c, d_r = d_given[0, t], d_given[1, t], d_given[2, t], d_through[t]
            np.multiply(c, c, out=d_c)
            np.subtract(1, d_c, out=d_c)
            d_c *= dz
            np.multiply(d_c, r, out=d_r)
            np.subtract(1, z, out=g_z)
            g_z *= moved
            g_z *= dz
            np.subtract(1, r, out=g_r)
            g_r *= through
            g_r *= d_r
            np.subtract(d, dz, out=carry)
            carry += g_z @ back[0]
            carry += g_r @ back[1]
            carry += d_r @ back[2]
        before = np.concatenate([state[None], states[:-1]]).reshape(-1, h).T
        d_hidden = np.concatenate([before @ x.reshape(-1, h) for x in (d_given[0], d_given[1], d_through)], 1)
        # one row for each token: sort by token and add up the runs
        seen = inputs.ravel()
        by = np.argsort(seen, kind="stable")
        first = np.flatnonzero(np.append(True, seen[by][1:] != seen[by][:-1]))
        each = room.of("each", len(by), 3 * h)
        for k, x in enumerate(d_given):
            each[:, k * h : k * h + h] = x.reshape(-1, h).take(by, axis=0)
        sums = np.add.reduceat(each, first, axis=0)
        used = seen[by][first]
        d_embed = np.zeros_like(self.embed)
        d_embed[used] = sums @ self.given.T
        return [d_embed, self.embed[used].T @ sums, d_hidden, d_out, d_member], states[-1]


def lanes(texts: list[np.ndarray], end: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of similar length side by side: their numbers, tokens (time x lanes; all end with `end`), which are live."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out = []
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        sizes = np.array([len(texts[i]) for i in own])
        out.append((np.array(own), sizes, [texts[i] for i in own]))
    return out


def windows(sizes: np.ndarray, texts: list[np.ndarray], end: int, cells: int = 0):
    """The windows of texts side by side: the lanes that go on (from this one on, as lengths ascend), inputs, targets, which are live. Only a window of each long text is laid out at a time.

    cells: where few lanes are left, windows grow up to so many tokens of all lanes.
    """
    last, a = np.full(len(texts), end, np.uint16), 0
    while a < int(sizes[-1]):
        keep = int(np.searchsorted(sizes, a, "right"))
        span = min(max(WINDOW, cells // (len(texts) - keep)), int(sizes[-1]) - a)
        targets = np.full((len(texts) - keep, span), end, np.uint16)
        for row, text in zip(targets, texts[keep:]):
            part = text[a : a + span]
            row[: len(part)] = part
        targets = np.ascontiguousarray(targets.T)
        inputs = np.concatenate([last[None, keep:], targets[:-1]])
        last[keep:] = targets[-1]
        yield keep, inputs, targets, (np.arange(a, a + span)[:, None] < sizes[None, keep:]).astype(np.float32)
        a += span


def fit(network: Network, texts: list[np.ndarray], end: int, rate: float) -> Network:
    """One pass over all windows of all texts, with Adam steps; the state is carried from window to window of a text."""
    params, kinds, room = network.arrays(), network.vocabulary.class_of(), Room()
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    groups = lanes(texts, end)
    order = np.random.default_rng(len(texts)).permutation(len(groups))
    total = sum(-(-int(g[1][-1]) // WINDOW) for g in groups)
    for g in order:
        _, sizes, own = groups[g]
        state = np.zeros((len(own), network.hidden.shape[0]), np.float32)
        for keep, inputs, targets, live in windows(sizes, own, end):
            grads, new = network.train(inputs, targets, live, state[keep:], kinds, room)
            state[keep:] = new
            step += 1
            now = rate * min(1.0, step / 20) * max(0.05, 1 - step / total)
            for p, d, m, v in zip(params, grads, first, second):
                m *= 0.9
                m += np.multiply(d, 0.1, out=room.of("step", *d.shape))
                d *= d
                d *= 0.01
                v *= 0.99
                v += d
                # d becomes the step
                np.multiply(v, 1 / (1 - 0.99**step), out=d)
                np.sqrt(d, out=d)
                d += 1e-6
                np.divide(m, d, out=d)
                d *= now / (1 - 0.9**step)
                p -= d
    return network


def score(network: Network, texts: list[np.ndarray], end: int) -> np.ndarray:
    """The natural logarithm of each whole text's probability as a sequence of tokens."""
    out, kinds, table, safe, room = np.zeros(len(texts)), network.vocabulary.class_of(), network.blocks(network.embed @ network.given), network.safe(), Room()
    for numbers, sizes, own in lanes(texts, end):
        state = np.zeros((len(own), network.hidden.shape[0]), np.float32)
        for keep, inputs, targets, live in windows(sizes, own, end, CELLS):
            states, _ = network.forward(inputs, state[keep:], table, False, room)
            target = targets.ravel()
            own_kinds = kinds[target]
            order, segments = network.members(own_kinds)
            # class by class, so that each class's rows lie together
            joint, place = network.joint(states).take(order, axis=0), (target.astype(np.int64) - network.vocabulary.single)[order]
            shares = _log_shares(np.matmul(joint, network.out, out=room.of("classes", len(joint), network.out.shape[1])), own_kinds[order], safe)
            for a, b, x, y in segments:
                shares[a:b] += _log_shares(joint[a:b] @ network.member[x:y].T, place[a:b] - x, safe)
            gained = np.empty_like(shares)
            gained[order] = shares
            out[numbers[keep:]] += (gained.reshape(targets.shape) * live).sum(0, dtype=np.float64)
            state[keep:] = states[-1]
    return out
