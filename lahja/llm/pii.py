"""Personal data and secrets by a character-level bidirectional LSTM with CRF transitions, in numpy.

The network reads classes of characters in both directions and scores a tag for each character; transitions
between tags are learned with it by the likelihood of the whole sequence, and Viterbi decoding finds the best
one. It is trained from labelled spans: any texts with spans (``fit``), by default texts of made-up words in which values
of each kind and of many shapes are planted among harmless numbers, codes and addresses (``labelled``), with fixed seeds, so
weights are the same on every run. Kinds: e-mail, phone, IP address, payment card, account (IBAN, social security
number), secret (keys, tokens, passwords). Names, streets and values that are spelled out are none of them.

A text is covered by overlapping windows of WIDTH characters at every STRIDE, however long it is; every window goes through the
network. A window that ends with its text before WIDTH has up to TAIL more characters PAD, as in training; no
score depends on which other texts are read at the same time. Where windows overlap, their scores are averaged, with less weight towards a window's edge, and one Viterbi decoding runs over the whole text, so that
transitions cross all seams. Most characters are certainly "none": no run of other tags through them could gain more than
it loses, whatever the transitions (a bound by running sums). The rest is decoded between them, which is exactly the best path of
the whole text; a test holds it against all paths.

One scan of the documents, no shuffle; only the text column goes to Python, and the weights broadcast are some kB.

Defined results: null or empty texts have no spans and stay as they are. Rows that repeat give their spans again;
null ids are kept. Offsets count code points; the end is exclusive; a value has no white space at its
ends and doesn't end within a run of letters and digits; an e-mail address has an at sign, a number of any kind but a secret a digit. Very long texts are
read whole. Other columns, whatever their names, don't matter and are carried by ``redact``.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NUMBER, batches, classes, codes, flat

KINDS = ("none", "email", "phone", "ip", "card", "account", "secret")
#: Windows of decoding, and those of training, which are shorter so that there are more steps.
WIDTH, STRIDE = 512, 448
FIT_WIDTH, FIT_STRIDE = 256, 192
#: Characters PAD that follow a text's end within its last window.
TAIL = 16
HIDDEN = 16
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_MARKS = " \n\t.@+-()\"'=:/_,#%&*$!|;?<>[]{}"
N_CLASSES = 26 + 1 + 1 + len(_MARKS) + 3


@functools.cache
def _class_table() -> np.ndarray:
    """Of the code points below 0x10000: lower-case letters alone, capitals, digits, marks, other letters, rest."""
    table = np.full(0x10000, N_CLASSES - 1, np.uint8)
    table[: 0x10000][classes()[:0x10000] == 0] = N_CLASSES - 2
    table[np.flatnonzero(classes()[:0x10000] == NUMBER)] = 27
    table[97:123] = np.arange(26)
    table[65:91] = 26
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 28 + i
    return table


PAD = N_CLASSES - 3


def char_classes(cp: np.ndarray) -> np.ndarray:
    return _class_table()[np.minimum(cp, 0xFFFF)]


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


#: exp(-x) is the 32nd power of the cubic at -x/32, which is v * v * v + _LINEAR * v + 1/3 of v = _ONE + _SLOPE * x: passes of sums and products only, some times
#: faster than numpy's exp and tanh. Gates come out within 1e-5 as long as x is within FAR of 0.
_ONE, _SLOPE, _LINEAR, FAR = np.float32(6 ** (-1 / 3)), -(6 ** (-1 / 3)) / 32, np.float32(3 * 6 ** (-2 / 3)), 64


_SCRATCH: dict[str, np.ndarray] = {}


def _scratch(name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
    """An array with anything in it, on pages that the process has already: fresh ones for every batch cost CPU seconds."""
    size = int(np.prod(shape))
    if name not in _SCRATCH or len(_SCRATCH[name]) < size:
        _SCRATCH[name] = np.empty(size, kind)
    return _SCRATCH[name][:size].reshape(shape)


def _plus_exp(v: np.ndarray, room: np.ndarray) -> None:
    """1 + exp(-x) in place of v."""
    np.multiply(v, v, out=room)
    room += _LINEAR
    v *= room
    v += np.float32(1 / 3)
    for _ in range(5):
        np.multiply(v, v, out=v)
    v += np.float32(1)


class Tagger:
    """wx: class to gates, wh: hidden to gates (input, forget, output, candidate), for both directions; out, bias: to tags; move, begin: CRF."""

    def __init__(self, seed: int = 0, hidden: int = HIDDEN, tags: int = len(KINDS)):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            wx = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            wx[:, hidden : 2 * hidden] += 1
            self.p["wx" + d], self.p["wh" + d] = wx, rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        self.p |= {"out": rng.normal(0, 0.2, (2 * hidden, tags)), "bias": np.zeros(tags), "move": np.zeros((tags, tags)), "begin": np.zeros(tags)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.hidden = hidden

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states [T, B, H] of windows x [B, T]; for training also what the way back needs."""
        wx, wh, n = self.p["wx" + d], self.p["wh" + d], self.hidden
        b, t = x.shape
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out = np.empty((t, b, n), np.float32)
        saved = []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[x[:, k]]
            z += h @ wh
            z[:, : 3 * n] *= 0.5
            np.tanh(z, out=z)
            z[:, : 3 * n] *= 0.5
            z[:, : 3 * n] += 0.5
            c0, h0 = c, h
            c = z[:, n : 2 * n] * c0 + z[:, :n] * z[:, 3 * n :]
            tc = np.tanh(c)
            h = z[:, 2 * n : 3 * n] * tc
            out[k] = h
            if keep:
                saved.append((k, z, c0, tc, h0))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x, "b", keep)
        h = np.concatenate([f, b], 2)
        return h @ self.p["out"] + self.p["bias"], h, sf, sb

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Emissions [B, T, tags] for decoding, without the bias, up to the next call; zeros follow the tags up to a multiple of 8.

        Windows x come longest first, sizes are their lengths; each takes as many steps as it has characters, whatever it lies with. Both
        directions go in one step, the way back from each window's own end. Weights and states are scaled so that gates leave the products
        as ``_plus_exp`` takes them."""
        n, (b, t), k = self.hidden, x.shape, len(self.p["bias"])
        by = np.where(np.arange(4 * n) < 3 * n, 1, 2) * _SLOPE  # tanh(z) is 2 sigma(2 z) - 1
        parts = [[(self.p[w + d] * by).reshape(-1, 4, n).transpose(1, 0, 2) for d in "fb"] for w in ("wx", "wh")]
        reach = float((np.abs(parts[0]).max(2) + np.abs(parts[1]).sum(2)).max()) / -_SLOPE
        table = (np.stack(parts[0], 1) + _ONE).astype(np.float32).reshape(-1, n)
        wh, out = (2 * np.stack(parts[1], 1)).astype(np.float32), np.pad(2 * self.p["out"].reshape(2, n, k), ((0, 0), (0, 0), (0, -k % 8)))
        place = (np.arange(8) * N_CLASSES).reshape(4, 2, 1)
        back = np.maximum(sizes[:, None] - 1 - np.arange(t), 0)
        steps = np.stack([x.T, np.take_along_axis(x, back, 1).T], 1).astype(np.intp)
        live = np.searchsorted(-sizes, -np.arange(t), "left").tolist()
        e = _scratch("e", t, 2, b, out.shape[2])
        room = [_scratch(f"room{i}", k * b * n) for i, k in enumerate((8, 8, 2, 2, 2))]
        room[3][:] = room[4][:] = 0
        unit, half, slope = np.float32(1), np.float32(0.5), np.float32(2 * _SLOPE)
        low, high, most = np.float32(_ONE + FAR * _SLOPE), np.float32(_ONE - FAR * _SLOPE), np.float32(-40 * _SLOPE)
        h, c = room[3].reshape(2, b, n), room[4].reshape(2, b, n)
        m, far = 0, False
        for i in range(t):
            if live[i] != m:  # shorter windows are over
                m = live[i]
                old, (z, u, v, h, c) = (h[:, :m].copy(), c[:, :m].copy()), (r[: len(r) // b * m].reshape(-1, 2, m, n) for r in room)
                v, h, c = v[0], h[0], c[0]
                h[:], c[:] = old
            np.take(table, steps[i, :, :m] + place, 0, out=z, mode="clip")
            np.matmul(h, wh, out=u)
            z += u
            if reach > FAR:
                np.clip(z, low, high, out=z)
            _plus_exp(z, u)
            gates, g = z[:3], z[3]  # input, forget, output; candidate
            np.divide(unit, gates, out=gates)
            np.divide(2 * slope, g, out=g)
            g -= slope
            g *= z[0]
            c *= z[1]
            c += g
            if i % 8 == 0:  # a cell grows by 1 a step at most
                far = float(np.abs(c, out=v).max()) > 0.4 * most
            if far:
                np.clip(c, -most, most, out=v)  # where tanh is 1
                v += _ONE
            else:
                np.add(c, _ONE, out=v)
            _plus_exp(v, g)
            np.divide(unit, v, out=v)
            v -= half  # states and cells are halves, so that no pass doubles them
            np.multiply(v, z[2], out=h)
            np.matmul(h, out, out=e[i, :, :m])
        e, own = e.reshape(t * 2 * b, -1), np.arange(b)[:, None]
        both, other, at = _scratch("both", b, t, out.shape[2]), _scratch("other", b, t, out.shape[2]), _scratch("at", b, t, kind=np.intp)
        np.take(e, np.add(np.arange(t) * (2 * b), own, out=at), 0, out=both, mode="clip")
        back *= 2 * b
        np.take(e, np.add(back, own + b, out=at), 0, out=other, mode="clip")
        both += other
        return both

    def certain(self, e: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Whether a character is "none" on every best path; head marks the first one of each text.

        A run of other tags gains at most W - gap at each of its characters and C in all over "none" throughout."""
        move, begin = self.p["move"].astype(np.float64), self.p["begin"].astype(np.float64)
        none = move[0, 0]
        w = float((move[1:, 1:] - none).max())
        enter = max(float((move[0, 1:] - none).max()), float((begin[1:] - begin[0]).max()))
        leave = max(float((move[1:, 0] - none).max()), 0.0)
        gain = w + (np.maximum.reduce(e[1:]) - e[0]).astype(np.float64)
        # the best sums of stretches that end or begin here; texts are kept apart by a great loss
        text = np.cumsum(head)
        wall = (np.abs(gain).sum() + abs(enter) + abs(leave) + abs(w) + 1) * text
        acc = np.concatenate([[0.0], np.cumsum(gain)])
        left = acc[1:] - wall - np.minimum.accumulate(acc[:-1] - wall)
        wall = wall[::-1]
        back = np.concatenate([[0.0], np.cumsum(gain[::-1])])
        right = (back[1:] + wall - np.minimum.accumulate(back[:-1] + wall))[::-1]
        return left + right - gain - w + enter + leave < -1e-6

    def best(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi tags of texts that lie one after another, each as a whole; e is [tags, characters]."""
        tags = np.zeros(e.shape[1], np.uint8)
        if not len(tags):
            return tags
        own = sizes[sizes > 0]
        head, last = np.zeros(len(tags), bool), np.zeros(len(tags), bool)
        head[np.cumsum(own) - own] = last[np.cumsum(own) - 1] = True
        open_ = ~self.certain(e, head)
        edge = np.append(True, (open_[1:] != open_[:-1]) | head[1:])
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(tags)))
        start, size = start[open_[start]], size[open_[start]]
        order = np.argsort(size, kind="stable")
        start, size = start[order], size[order]
        at = 0
        while at < len(start):
            # as many stretches as make some 10**5 cells
            stop = max(at + 1, int(np.searchsorted(np.arange(1, len(start) - at + 1) * size[at:], 1 << 17, "right")) + at)
            s, n = start[at:stop], size[at:stop]
            tags[flat(s, n)] = self._viterbi(e, s, n, head[s], last[s + n - 1])
            at = stop
        return tags

    def _viterbi(self, e: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tags of stretches between characters that are "none" (or a text's ends), one after another."""
        move, begin, k = self.p["move"], self.p["begin"], len(e)
        t = int(size.max())
        score = e[:, start].T + np.where(first[:, None], begin, move[0])
        back = np.zeros((t, len(start), k), np.uint8)
        final = np.zeros((len(start), k), np.float32)
        rows = np.arange(len(start))
        for i in range(t):
            live = np.flatnonzero(size > i)
            if i:
                step = score[live][:, :, None] + move
                back[i, live] = step.argmax(1)
                score[live] = step.max(1) + e[:, start[live] + i].T
            done = np.flatnonzero(size == i + 1)
            final[done] = score[done] + np.where(last[done, None], 0, move[:, 0])
        out = np.empty((len(start), t), np.uint8)
        tag = final.argmax(1)
        for i in range(t - 1, -1, -1):
            out[:, i] = tag
            own = (size > i) & (i > 0)
            tag = np.where(own, back[i, rows, tag], tag)
        return out[np.arange(t) < size[:, None]]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradient."""
        e, h, sf, sb = self.emissions(x, True)
        t, b, k = e.shape
        move, begin = np.exp(self.p["move"].astype(np.float64)), np.exp(self.p["begin"].astype(np.float64))
        # forward and backward sums in linear space, scaled at every step
        top = e.max(2, keepdims=True)
        p = np.exp((e - top).astype(np.float64))
        alpha, beta, scale = np.empty((t, b, k)), np.ones((t, b, k)), np.empty((t, b, 1))
        for i in range(t):
            a = (begin if i == 0 else alpha[i - 1] @ move) * p[i]
            scale[i] = a.sum(1, keepdims=True)
            alpha[i] = a / scale[i]
        for i in range(t - 2, -1, -1):
            beta[i] = (p[i + 1] * beta[i + 1]) @ move.T / scale[i + 1]
        z = (np.log(scale) + top).sum((0, 2))
        de = alpha * beta
        rows, steps = np.arange(b), np.arange(t)[:, None]
        into = p[1:] * beta[1:] / scale[1:]
        dmove = np.einsum("tbi,tbj->ij", alpha[:-1], into, optimize=True) * move
        yt = y.T
        gold = e.astype(np.float64)[steps, rows, yt].sum(0) + np.log(begin)[y[:, 0]] + np.log(move)[y[:, :-1], y[:, 1:]].sum(1)
        np.subtract.at(dmove, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de[steps, rows, yt] -= 1
        g = {"move": dmove / b, "begin": de[0].sum(0) / b}
        de = (de / b).astype(np.float32)
        g["out"] = np.einsum("tbh,tbk->hk", h, de)
        g["bias"] = de.sum((0, 1))
        dh = de @ self.p["out"].T
        n = self.hidden
        for d, saved, own in (("f", sf, dh[:, :, :n]), ("b", sb, dh[:, :, n:])):
            wh = self.p["wh" + d]
            dwx, dwh = np.zeros_like(self.p["wx" + d]), np.zeros_like(wh)
            dzs = np.empty((t, b, 4 * n), np.float32)
            nh, nc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for i, gate, c0, tc, h0 in reversed(saved):
                gi, gf, go, gg = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n : 3 * n], gate[:, 3 * n :]
                dout = own[i] + nh
                dc = dout * go * (1 - tc * tc) + nc
                dz = np.concatenate([dc * gg * gi * (1 - gi), dc * c0 * gf * (1 - gf), dout * tc * go * (1 - go), dc * gi * (1 - gg * gg)], 1)
                dzs[i] = dz
                dwh += h0.T @ dz
                nh, nc = dz @ wh.T, dc * gf
            order = np.argsort(x.T.ravel(), kind="stable")
            seen, first = np.unique(x.T.ravel()[order], return_index=True)
            dwx[seen] = np.add.reduceat(dzs.reshape(t * b, -1)[order], first)
            g["wx" + d], g["wh" + d] = dwx, dwh
        return float((z - gold).mean()), g


def _word(rng) -> str:
    letters = "etaoinshrdlucmfwypvbgkjqxz" if rng.random() < 0.7 else "éèäöüßñçêóíabcdefaeiou"
    w = "".join(letters[min(int(rng.exponential(6)), len(letters) - 1)] for _ in range(1 + rng.poisson(4) + (rng.poisson(14) if rng.random() < 0.04 else 0)))
    r = rng.random()
    return w.upper() if r < 0.08 else w.capitalize() if r < 0.2 else w


def _of(rng, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


_UPPER, _LOWER, _DIGITS, _HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def _digits(rng, n: int) -> str:
    return _of(rng, _DIGITS, n)


def _plain(rng) -> str:
    """A word, or a harmless number, code or address."""
    r = rng.random()
    if r < 0.86:
        return _word(rng) + ("" if r < 0.7 else rng.choice([",", ".", "!!", "###", "%%%", "$$$", "&&&", "***", ";", ":", " |", "...", "?", "(", ")", "\"", "'s"]))
    w = _word(rng)
    return str(rng.choice([
        f"{rng.integers(1, 10)}.{rng.integers(0, 10)}.", f"version {rng.integers(1, 10)}.", f"Version {rng.integers(1, 10)}.{rng.integers(0, 10)}.", str(rng.integers(0, 3000)), f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        f"{rng.integers(0, 24)}:{_digits(rng, 2)}", f"${rng.integers(1, 999)}.{_digits(rng, 2)}", f"({_digits(rng, 4)})", f"{rng.integers(1, 99)}%", f"#{_digits(rng, 3)}", f"{w}{_digits(rng, 2)}", f"@{w}",
        f"{rng.integers(1, 10)}.{rng.integers(0, 10)}.{rng.integers(0, 10)}", f"{_digits(rng, 2)}/{_digits(rng, 2)}/{_digits(rng, 4)}", f"{_digits(rng, 2)}.{_digits(rng, 2)}.{_digits(rng, 4)}", f"{rng.integers(1, 999)},{_digits(rng, 3)}", f"{_digits(rng, 5)}", f"v{rng.integers(1, 9)}", f"= {rng.integers(1, 100)}",
        f"http://{w}.com/{_word(rng)}", f"www.{w}.org", f"https://{w}.{_word(rng)}/{_digits(rng, 3)}?{_word(rng)}={_digits(rng, 2)}", f"{w}/{_word(rng)}.txt", f"#{_of(rng, _HEX, 6)}", f"{w}_{_word(rng)}", f"{w}-{_word(rng)}", f"{w}.{_word(rng)}", f"{w}({_word(rng)})", f"{w} = {_word(rng)};", "-" * int(rng.integers(2, 60)), "=" * int(rng.integers(2, 40)),
        f"<{w}>", f"</{w}>", f"{w}: {_word(rng)}", f"§ {rng.integers(1, 300)}", f"{_digits(rng, 3)} {_digits(rng, 3)}", f"{rng.integers(10, 99)}-{rng.integers(10, 99)}", f"key {w}", f"token {w}", f"password {w}", f"secret {w}",
    ]))


def _phone(rng) -> str:
    sep = str(rng.choice([" ", "-", "."], p=[0.45, 0.45, 0.1]))
    sizes = [[3, 3, 4], [3, 3, 4], [3, 3, 4], [2, 2, 2, 2, 2], [3, 4, 4], [2, 4, 4], [4, 3, 3], [3, 6], [5, 6], [2, 3, 2, 2], [1, 2, 2, 2, 2], [3, 3, 3]][int(rng.integers(0, 12))]
    groups = [_digits(rng, n) for n in sizes]
    if len(groups) == 3 and rng.random() < 0.3:
        groups[1] = "555"[: len(groups[1])].ljust(len(groups[1]), "5")
    r = rng.random()
    if r < 0.35:
        tail = f"{groups[1]}-{sep.join(groups[2:])}" if len(groups) > 2 else groups[1]
        return (f"+{rng.integers(1, 99)} " if rng.random() < 0.6 else "") + f"({groups[0]}) {tail}"
    lead = f"+{rng.integers(1, 99)}{sep}" if r < 0.75 else f"00{rng.integers(20, 99)}{sep}" if r < 0.8 else ""
    return lead + sep.join(groups)


def _secret(rng) -> str:
    r = rng.random()
    if r < 0.42:
        return _of(rng, _HEX if rng.random() < 0.9 else _HEX.upper(), int(rng.choice([40, 40, 40, 32, 64, 48])))
    if r < 0.62:
        return _of(rng, _UPPER + _LOWER + _DIGITS + "+/", int(rng.integers(24, 64))) + str(rng.choice(["", "", "=", "=="]))
    if r < 0.9:
        lead = str(rng.choice(["AKIA", "AKIA", "ASIA", "ghp_", "sk_live_", "sk-", "xoxb-", "AIza", "glpat-", "pk_test_"]))
        return lead + (_of(rng, _UPPER + _DIGITS, 16) if lead[1:] in ("KIA", "SIA") else _of(rng, _UPPER + _LOWER + _DIGITS, int(rng.integers(16, 40))))
    return _of(rng, _LOWER + _UPPER + _DIGITS, int(rng.integers(20, 40)))


def _value(rng, kind: str) -> tuple[str, str, str]:
    """(before, value, after)."""
    w = lambda: "".join(c for c in _word(rng).lower() if c.isascii()) or "ab"
    if kind == "email":
        user = rng.choice([f"{w()}.{_digits(rng, 2)}", f"{w()}.{w()}", f"{w()}.{w()}{_digits(rng, 2)}", f"{w()}{_digits(rng, 3)}", w(), f"{w()}_{w()}", f"{w()}-{_digits(rng, 1)}", f"{w()}+{w()}", w().capitalize()])
        host = rng.choice([f"mail{_digits(rng, 1)}.example", w(), f"{w()}.{w()}", f"{w()}{_digits(rng, 1)}", "example", f"{w()}-{w()}"])
        return str(rng.choice(["", "", "", "<", "mailto:", "("])), f"{user}@{host}.{rng.choice(['com', 'org', 'net', 'fr', 'de', 'es', 'io', 'co.uk', 'edu', 'gov', w()[:3].ljust(2, 'o')])}", ""
    if kind == "phone":
        return str(rng.choice(["", "", "", "tel ", "Tel: ", "call "])), _phone(rng), ""
    if kind == "ip":
        if rng.random() < 0.7:
            return "", ".".join(str(rng.integers(0, 256)) for _ in range(4)), str(rng.choice(["", "", ":8080"]))
        groups = [_of(rng, _HEX, int(rng.integers(1, 5))) for _ in range(8)]
        cut = int(rng.integers(2, 7))
        return "", ":".join(groups) if rng.random() < 0.5 else ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 1 :]), ""
    if kind == "card":
        d = _digits(rng, 16)
        r = rng.random()
        return "", d if r < 0.6 else d[:15] if r < 0.7 else f"{d[:4]} {d[4:10]} {d[:5]}" if r < 0.75 else str(rng.choice(["-", " "])).join(d[i : i + 4] for i in range(0, 16, 4)), ""
    if kind == "account":
        if rng.random() < 0.5:
            return str(rng.choice(["", "SSN ", "ssn: "])), f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", ""
        body = _of(rng, _UPPER, 2) + _digits(rng, 2) + (_of(rng, _UPPER, 4) if rng.random() < 0.3 else _digits(rng, 4)) + _digits(rng, int(rng.integers(8, 19)))
        return str(rng.choice(["", "IBAN ", "IBAN: "])), body if rng.random() < 0.5 else " ".join(body[i : i + 4] for i in range(0, len(body), 4)), ""
    name = str(rng.choice(["token", "token", "token", "key", "api_key", "secret", "password", "access_token", "pwd", "API_KEY", "auth"]))
    value = _secret(rng)
    quoted = int(rng.choice([0, 0, 0, 1, 2, 3, 4, 5]))
    if rng.random() < 0.2:  # a password, told by what it stands behind
        value, name = _of(rng, _LOWER + _UPPER + _DIGITS + "!#$%*_", int(rng.integers(8, 17))), str(rng.choice(["password", "pwd", "passwd"]))
        quoted = min(quoted, 3)
    before, after = {0: (f'{name} = "', '"'), 1: (f'{name}="', '"'), 2: (f"{name}: ", ""), 3: (f"{name} = '", "'"), 4: ("", ""), 5: (f"{name.upper()}=", "")}[quoted]
    return before, value, after


def labelled(seed: int, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts of some 770 characters with the spans planted in them."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        often = 0.0 if rng.random() < 0.15 else 0.12  # some texts have none
        shout = rng.random() < 0.1
        while len(text) < 770:
            r = rng.random()
            if r < often:
                kind = KINDS[1 + int(rng.integers(0, len(KINDS) - 1))]
                before, value, after = _value(rng, kind)
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
                text += before + value + after + (str(rng.choice(["", "", ".", ",", "!!", "###", "%%%", "$$$", "&&&", "***", " |"])) if rng.random() < 0.5 else "")
            else:
                own = _plain(rng).upper() + "!!" if shout else _plain(rng)
                text += " ".join([own] * (int(rng.integers(3, 40)) if rng.random() < 0.01 else 1))
            text += "\n" if rng.random() < 0.08 else " "
        out.append((text, spans))
    return out


def windows(sizes: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all windows of texts; the last one of a text may reach beyond it."""
    n = np.where(sizes > 0, 1 + np.maximum(-(-(sizes - width) // stride), 0), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride


def _cells(cls: np.ndarray, begins: np.ndarray, sizes: np.ndarray, text: np.ndarray, start: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Classes [windows, width]; PAD outside of the text."""
    spot = start[:, None] + np.arange(width)
    inside = (spot >= 0) & (spot < sizes[text][:, None])
    return np.where(inside, cls[np.where(inside, spot + begins[text][:, None], 0)], PAD).astype(np.uint8)


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 7, batch: int = 96, rate: float = 0.02, seed: int = 0) -> Tagger:
    """Tagger of labelled texts: (text, [(kind, start, end)])."""
    xs, ys = [], []
    for text, spans in examples:
        cls = char_classes(codes(text))
        tag = np.zeros(len(cls), np.uint8)
        for kind, a, b in spans:
            tag[a:b] = KINDS.index(kind)
        begins, sizes = np.zeros(1, np.int64), np.array([len(cls)])
        own, start = windows(sizes, FIT_WIDTH, FIT_STRIDE)
        xs.append(_cells(cls, begins, sizes, own, start, FIT_WIDTH))
        y = _cells(tag, begins, sizes, own, start, FIT_WIDTH)
        ys.append(np.where(y == PAD, 0, y))
    x, y = np.concatenate(xs), np.concatenate(ys)
    net = Tagger(seed)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    var = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps, total = 0, epochs * (-(-len(x) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            _, g = net.gradient(x[order[i : i + batch]], y[order[i : i + batch]].astype(np.int64))
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            steps += 1
            lr = rate * (1 - steps / (total + 1))
            for k, v in g.items():
                v = (v * min(1.0, 20 / norm)).astype(np.float32)
                mean[k] = 0.9 * mean[k] + 0.1 * v
                var[k] = 0.98 * var[k] + 0.02 * v * v
                net.p[k] -= (lr * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(var[k] / (1 - 0.98**steps)) + 1e-6)).astype(np.float32)
    return net


@functools.cache
def trained(texts: int = 900, seed: int = 1) -> Tagger:
    return fit(labelled(seed, texts))


#: A window's say: little at its edges, where it lacks context.
_WEIGHT = np.minimum(1, (1 + np.minimum(np.arange(WIDTH), WIDTH - 1 - np.arange(WIDTH))) / (WIDTH - STRIDE)).astype(np.float32) ** 4


def emissions_of(net: Tagger, cp: np.ndarray, sizes: np.ndarray, at_once: int = 1280) -> np.ndarray:
    """Averaged scores [tags, characters] of texts that lie one after another in cp. A text's don't depend on the others, nor on at_once."""
    begins = np.cumsum(sizes) - sizes
    text, start = windows(sizes, WIDTH, STRIDE)
    cls = char_classes(cp)
    tags = len(net.p["bias"])
    total, times = np.zeros((len(cp), tags + -tags % 8), np.float32), np.zeros(len(cp), np.float32)
    say = np.repeat(_WEIGHT[:, None], total.shape[1], 1)
    at = begins[text] + start
    n = np.minimum(WIDTH, sizes[text] - start)
    steps = np.minimum(WIDTH, n + TAIL)
    order = np.argsort(-steps, kind="stable")
    each = max(1, -(-len(order) // max(1, -(-len(order) // at_once))))
    for i in range(0, len(order), each):
        w = order[i : i + each]
        e = net.scores(_cells(cls, begins, sizes, text[w], start[w], int(steps[w[0]])), steps[w])
        for own, p, m, s in zip(e, at[w].tolist(), n[w].tolist(), start[w].tolist()):
            # a window has its full say at the text's own ends
            weight = say[:m] if m == WIDTH else np.maximum(say[:m], np.arange(m)[:, None] >= WIDTH - STRIDE if s else 1)
            own = own[:m]
            own *= weight
            total[p : p + m] += own
            times[p : p + m] += weight[:, 0]
    e = np.ascontiguousarray(total.T[:tags])
    e /= times
    e += net.p["bias"][:, None]
    return e


def tags_of(net: Tagger, cp: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tag of each character of texts that lie one after another in cp."""
    return net.best(emissions_of(net, cp, sizes), sizes)


def find(net: Tagger, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text."""
    parts = [t or "" for t in texts]
    cp = codes("".join(parts))
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not len(cp):
        return out
    tags = tags_of(net, cp, sizes)
    owner = np.repeat(np.arange(len(parts)), sizes)
    turn = np.flatnonzero(np.append(True, (tags[1:] != tags[:-1]) | (owner[1:] != owner[:-1])))
    stop = np.append(turn[1:], len(tags))
    inner = classes()[cp] <= NUMBER
    for a, b in zip(turn[tags[turn] > 0].tolist(), stop[tags[turn] > 0].tolist()):
        while a < b and chr(cp[a]).isspace():
            a += 1
        while b > a and chr(cp[b - 1]).isspace():
            b -= 1
        if b > a:
            d, kind = int(owner[a]), KINDS[tags[a]]
            # a value doesn't end within a run of letters and digits
            lo, hi = int(begins[d]), int(begins[d] + sizes[d])
            while a > lo and inner[a] and inner[a - 1] and not tags[a - 1]:
                a -= 1
            while b < hi and inner[b - 1] and inner[b] and not tags[b]:
                b += 1
            # what the kind's definition rules out is none: an address without its sign, a number without a digit
            if kind == "secret" or bool((cp[a:b] == 64).any() if kind == "email" else (classes()[cp[a:b]] == NUMBER).any()):
                out[d].append((kind, int(a - begins[d]), int(b - begins[d])))
    return out


def _finder(docs: DataFrame, net: Tagger):
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def search(own: list[str | None]):
        rows = []
        for a, b in batches(own):
            rows += find(shared.value, own[a:b])
        return rows

    return search


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Tagger | None = None) -> DataFrame:
    """(doc_id, kind, start, end, value), a row for each span."""
    search = _finder(docs, net or trained())

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        own = texts.tolist()
        return pd.Series([[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in found] for t, found in zip(own, search(own))], dtype=object)

    return docs.select(F.col(f"`{id_col}`"), run(F.col(f"`{text_col}`")).alias("spans")).where(F.size("spans") > 0).select(F.col(f"`{id_col}`"), F.inline("spans"))


def redact(docs: DataFrame, text_col: str = "text", net: Tagger | None = None) -> DataFrame:
    """The documents with each value replaced by its kind in brackets; columns as given."""
    search = _finder(docs, net or trained())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own, rows = texts.tolist(), []
        for t, found in zip(own, search(own)):
            for kind, a, b in reversed(found):
                t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
            rows.append(t)
        return pd.Series(rows, dtype=object)

    return docs.withColumn(text_col, run(F.col(f"`{text_col}`")))
