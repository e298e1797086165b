"""A small causal self-attention network over subword ids, in numpy.

Each place of a text is one subword id. Queries are the last ``SPAN`` places of a window;
keys and values are all ``CONTEXT + SPAN`` places of it that are not later and belong to the
same text. What attention gathers moves the odds of the next id's class; within its class
the next id is drawn as ids of that class follow ids of the last one's class:

    P(next | before) = softmax(follow[last] + attended @ out + bias)[class of next] * inside[class of last][next]

``follow`` and ``inside`` are counted, ``emb``, ``wq``, ``wk``, ``wv``, ``place``, ``out`` and ``bias`` are learned
by gradients. All arrays have fixed sizes, so a network weighs some 35 MB at any corpus.
"""

from __future__ import annotations

import copy

import numpy as np

PIECES, BEGIN, END = 32_000, 1, 2
CLASSES, WIDTH, CONTEXT, SPAN = 128, 16, 16, 32
BUCKETS = 64
PART, BATCH = 32, 512  # windows in one piece of work, and in one step of learning
NAMES = ("wq", "wk", "wv", "place", "out", "bias")
#: How far before each query a key stands; which keys aren't later, and their distances.
DISTANCE = CONTEXT + np.arange(SPAN)[:, None] - np.arange(CONTEXT + SPAN)[None, :]
_NEAR = np.flatnonzero(DISTANCE.ravel() >= 0)
_NEAR_DISTANCE = DISTANCE.ravel()[_NEAR]
_SCALE = WIDTH**-0.5


def windows(ends: np.ndarray):
    """Per window of texts that end at ``ends``: its first target, and the first and last place of its text."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = -(-(ends - begins) // SPAN)
    row = np.repeat(np.arange(len(ends)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return begins[row] + SPAN * k, begins[row], ends[row]


def _flat(m):
    return m.reshape(-1, m.shape[-1])


class Room:
    """Arrays that one piece of ``n`` windows after another is computed in; to allocate them for each takes longer than to fill them.

    ``load`` takes the small arrays of a network, as products need them. Values and what attention gathers have a last
    column of ones, which brings the sums of the attention along, and the bias. Products are taken a window at a time: so small
    ones aren't packed anew.
    """

    def __init__(self, n: int, kind=np.float32):
        length = CONTEXT + SPAN
        room = lambda *shape: np.empty(shape, kind)
        self.n, self.first = n, np.arange(n * SPAN) * CLASSES
        self.e, self.kv, self.de, self.dkv = (room(n, length, w) for w in (WIDTH, 2 * WIDTH + 1, WIDTH, 2 * WIDTH))
        self.k, self.v, self.dk, self.dv = self.kv[:, :, :WIDTH], self.kv[:, :, WIDTH:], self.dkv[:, :, :WIDTH], self.dkv[:, :, WIDTH:]
        self.q, self.dq, self.dlate, self.gathered, self.back = (room(n, SPAN, w) for w in (*[WIDTH] * 3, WIDTH + 1, WIDTH + 1))
        self.a, self.da = room(n, SPAN, length), room(n, SPAN, length)
        self.h, self.dh = room(n, SPAN, WIDTH + 1), room(n, SPAN, WIDTH + 1)
        self.z, self.follow = room(n, SPAN, CLASSES), room(n, SPAN, CLASSES)
        self.ones = np.ones(CLASSES, kind)
        self.v[:, :, WIDTH] = 1

    def load(self, net) -> Room:
        kind = self.z.dtype
        self.wq = (net.wq * _SCALE).astype(kind)
        self.wkv = np.hstack([net.wk, net.wv]).astype(kind)
        self.near = np.where(DISTANCE < 0, -1e9, net.place[np.maximum(DISTANCE, 0)]).astype(kind)
        self.out = np.vstack([net.out, net.bias]).astype(kind)
        self.wqt, self.wkvt = np.ascontiguousarray(self.wq.T), np.ascontiguousarray(self.wkv.T)
        self.outt = np.hstack([net.out.T, np.zeros((CLASSES, 1))]).astype(kind)
        return self


def _exp(m):
    """The exponentials, in place; no exponent is above 60."""
    if m.max() > 60:
        np.minimum(m, 60, out=m)
    return np.exp(m, out=m)


class Net:
    """The network: counted tables, learned arrays, and the class of each id."""

    def __init__(self, classes: np.ndarray, follow: np.ndarray, inside: np.ndarray, emb: np.ndarray):
        draw, d = np.random.default_rng(5), WIDTH
        self.classes, self.follow, self.inside = classes, follow.astype(np.float32), inside.astype(np.float32)
        self.emb = emb.astype(np.float32)
        self.wq, self.wk = (draw.normal(0, 0.1, (d, d)).astype(np.float32) for _ in range(2))
        self.wv = np.eye(d, dtype=np.float32)
        self.place = np.zeros(CONTEXT + SPAN, np.float32)
        self.out, self.bias = np.zeros((d, CLASSES), np.float32), np.zeros(CLASSES, np.float32)

    def copy(self) -> Net:
        """A network that can learn without changing this one."""
        new = copy.copy(self)
        new.emb = self.emb.copy()
        return new

    def take(self, ids, starts, lo, hi):
        """Of some windows: input ids, which of them lie inside the text, target ids, their places, which targets count."""
        places = starts[:, None] + np.arange(-CONTEXT - 1, SPAN)
        own = ids.take(places, mode="clip").astype(np.int64)
        x = own[:, :-1]
        first = np.flatnonzero(starts - lo <= CONTEXT)
        x[first, (lo - starts)[first] + CONTEXT] = BEGIN
        t = places[:, CONTEXT + 1:]
        return x, places[:, :-1] >= lo[:, None] - 1, ids.take(t, mode="clip").astype(np.int64), t, t < hi[:, None]

    def room(self, n: int, room: Room | None = None) -> Room:
        """``room``, if it is one for ``n`` windows, else a new one."""
        return room if room is not None and room.n == n else Room(n, self.emb.dtype).load(self)

    def odds(self, x, inside, room: Room):
        """Odds of the classes of the next ids, and their sums; what the gradients need stays in ``room``."""
        e = np.take(self.emb, x, axis=0, out=room.e, mode="clip")
        np.matmul(e[:, CONTEXT:], room.wq, out=room.q)
        np.matmul(e, room.wkv, out=room.kv[:, :, : 2 * WIDTH])
        a = np.matmul(room.q, room.k.transpose(0, 2, 1), out=room.a)
        a += room.near
        outside = np.flatnonzero(~inside[:, 0])
        if len(outside):
            a[outside] += np.where(inside[outside], 0, -1e9).astype(a.dtype)[:, None, :]
        h = np.matmul(_exp(a), room.v, out=room.gathered)
        np.multiply(h, 1 / h[:, :, WIDTH:], out=room.h)
        z = np.matmul(room.h, room.out, out=room.z)
        z += np.take(self.follow, x[:, CONTEXT:], axis=0, out=room.follow, mode="clip")
        z = _flat(_exp(z))
        return z, z @ room.ones

    def forward(self, x, inside):
        """Class probabilities of the next ids, and the room in which they were computed."""
        room = self.room(len(x))
        z, total = self.odds(x, inside, room)
        return z / total[:, None], room

    def gradients(self, x, inside, targets, valid, room: Room | None = None):
        """Gradients of the log probability of the counted targets, summed; those of ``emb`` by input place, until ``room`` is used again."""
        room = self.room(len(x), room)
        z, total = self.odds(x, inside, room)
        share = (valid.ravel() / -total).astype(z.dtype)[:, None]
        z.ravel()[room.first + self.classes[targets.ravel()]] -= total  # now z * share are the derivatives
        h, back, a, z = room.h, room.back, room.a, room.z
        share = share.reshape(*targets.shape, 1)
        out = (np.multiply(h, share, out=room.dh).transpose(0, 2, 1) @ z).sum(0)
        np.multiply(np.matmul(z, room.outt, out=room.dh), share / room.gathered[:, :, WIDTH:], out=back)
        back[:, :, WIDTH] = (back * h) @ -room.ones[: WIDTH + 1]
        da = np.matmul(back, room.v.transpose(0, 2, 1), out=room.da)
        da *= a
        dq, dkv = np.matmul(da, room.k, out=room.dq), room.dkv
        np.matmul(da.transpose(0, 2, 1), room.q, out=room.dk)
        np.matmul(a.transpose(0, 2, 1), back[:, :, :WIDTH], out=room.dv)
        np.matmul(dkv, room.wkvt, out=room.de)
        room.de[:, CONTEXT:] += np.matmul(dq, room.wqt, out=room.dlate)
        of_wq = (room.e[:, CONTEXT:].transpose(0, 2, 1) @ dq).sum(0)
        of_wkv = (room.e.transpose(0, 2, 1) @ dkv).sum(0)
        return {
            "wq": of_wq * a.dtype.type(_SCALE), "wk": of_wkv[:, :WIDTH], "wv": of_wkv[:, WIDTH:],
            "place": np.bincount(_NEAR_DISTANCE, da.reshape(room.n, -1).sum(0)[_NEAR], CONTEXT + SPAN).astype(np.float32),
            "out": out[:WIDTH], "bias": out[WIDTH], "emb": room.de,
        }

    def log_scores(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probability of every id of some texts; each is scored once."""
        out = np.zeros(len(ids))
        starts, lo, hi = windows(ends)
        room = None
        for b in range(0, len(starts), PART):
            s = slice(b, b + PART)
            x, inside, targets, t, valid = self.take(ids, starts[s], lo[s], hi[s])
            room = self.room(len(x), room)
            z, total = self.odds(x, inside, room)
            targets = targets.ravel()
            own = z.ravel()[room.first + self.classes[targets]] / total
            score = np.log(np.maximum(own, 1e-30)) + self.inside.ravel()[self.classes[x[:, CONTEXT:].ravel()] * PIECES + targets]
            out[t[valid]] = score[valid.ravel()]
        return out


class Learner:
    """Steps up the gradient: Adam for the small arrays, Adagrad for the embeddings that a batch holds."""

    def __init__(self, net: Net, rate=0.01, emb_rate=0.05):
        self.net, self.rate, self.emb_rate, self.t, self.m, self.v = net, rate, emb_rate, 0, {}, {}
        self.emb_sq = np.full(PIECES, 1e-12, np.float32)
        self.seen = np.zeros(PIECES)
        self.room = Room(PART, net.emb.dtype)
        self.des = np.empty((BATCH, CONTEXT + SPAN, WIDTH), np.float32)
        self.sorted = np.empty((self.des.size // WIDTH, WIDTH), np.float32)

    def step(self, ids, starts, lo, hi):
        """One step along the mean gradient of some windows."""
        net, total, n = self.net, {}, 0
        xs, des = np.empty((len(starts), CONTEXT + SPAN), np.uint16), self.des[: len(starts)]
        self.room.load(net)
        for b in range(0, len(starts), PART):
            s = slice(b, b + PART)
            x, inside, targets, _, valid = net.take(ids, starts[s], lo[s], hi[s])
            grads = net.gradients(x, inside, targets, valid, self.room)
            xs[s], des[s] = x, grads.pop("emb")
            n += int(valid.sum())
            for name, g in grads.items():
                total[name] = total.get(name, 0) + g
        self.t += 1
        for name, g in total.items():
            g = g / n
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
            move = self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
            setattr(net, name, (getattr(net, name) + move).astype(np.float32))
        order = np.argsort(xs, axis=None, kind="stable")
        x = xs.ravel()[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        used = x[first]
        g = np.add.reduceat(np.take(_flat(des), order, axis=0, out=self.sorted[: len(order)], mode="clip"), first, axis=0) / np.float32(n)
        self.emb_sq[used] += (g * g).mean(1)
        net.emb[used] += np.float32(self.emb_rate) * g / np.sqrt(self.emb_sq[used])[:, None]
        self.seen[used] += np.diff(np.append(first, len(x)))


def learn(net: Net, ids: np.ndarray, ends: np.ndarray) -> Learner:
    """Learn from every window of some texts, in their order."""
    learner = Learner(net)
    starts, lo, hi = windows(ends)
    for b in range(0, len(starts), BATCH):
        s = slice(b, b + BATCH)
        learner.step(ids, starts[s], lo[s], hi[s])
    return learner


def bucket(ids: np.ndarray) -> np.ndarray:
    """One of ``BUCKETS`` groups of ids, as the neighbours in profiles."""
    return (ids * 2_654_435_761 >> 7) % BUCKETS


def classes_and_places(profile: np.ndarray):
    """The class of each id, and where its embedding starts, from counts of what follows and precedes it.

    ``profile`` has a row for each id: counts of the buckets that follow, then of those that precede. Ids with like
    neighbours share a class (k-means from spread-out frequent ids); embeddings start at the main axes of the
    profiles. Ids never seen get classes in turn and start at 0.
    """
    classes, emb = np.arange(PIECES) % CLASSES, np.zeros((PIECES, WIDTH), np.float32)
    n = profile.sum(1)
    seen = np.flatnonzero(n)
    if not len(seen):
        return classes, emb
    halves = [profile[seen, :BUCKETS], profile[seen, BUCKETS:]]
    f = np.concatenate([np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)) for x in halves], 1).astype(np.float32)
    weight = np.sqrt(n[seen]).astype(np.float32)
    often = np.argsort(-n[seen], kind="stable")[:4096]
    picked = [often[0]]
    far = ((f[often] - f[picked[0]]) ** 2).sum(1)
    for _ in range(min(CLASSES, len(often)) - 1):
        picked.append(often[int((far * weight[often]).argmax())])
        far = np.minimum(far, ((f[often] - f[picked[-1]]) ** 2).sum(1))
    centres = f[picked]
    for _ in range(12):
        at = (2 * (f @ centres.T) - (centres * centres).sum(1)).argmax(1)
        mass = np.bincount(at, weight, len(centres))
        sums = np.stack([np.bincount(at, weight * f[:, j], len(centres)) for j in range(f.shape[1])], 1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres).astype(np.float32)
    classes[seen] = at
    off = f - (f * weight[:, None]).sum(0) / weight.sum()
    _, axes = np.linalg.eigh((off * weight[:, None]).T @ off / weight.sum())
    top = off @ (axes[:, ::-1][:, :WIDTH] * np.sign(axes[:, ::-1][:, :WIDTH].sum(0) + 1e-12))
    emb[seen] = np.clip(top / np.maximum(top.std(0), 1e-6), -3, 3)
    return classes, emb


def tables(classes: np.ndarray, unigram: np.ndarray, after: np.ndarray, into: np.ndarray):
    """Logs of ``follow`` and ``inside`` from counts: of ids, of (last id, next class) and of (last class, next id)."""
    plain = unigram + 0.01
    share = np.bincount(classes, plain, CLASSES)
    follow = np.log((after + 5 * share / share.sum()) / (after.sum(1, keepdims=True) + 5))
    both = np.stack([np.bincount(classes, row, CLASSES) for row in into])
    inside = np.log((into + 5 * plain / share[classes]) / (both[:, classes] + 5))
    return follow, inside
