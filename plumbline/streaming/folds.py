"""Order-dependent rules, each as one small fold used by batch replay and by streams alike.

A fold starts from ``init()`` and takes rows of one key in order: ``run(state, pdf)`` returns the
new state and an output frame. States are plain JSON values of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from plumbline import fixed

EDGES = np.array(fixed.PSI_EDGES)


def bins(values) -> np.ndarray:
    """Range number 0 to 9 per value, the last range closed; -1 outside."""
    v = np.asarray(values, dtype=float)
    b = np.searchsorted(EDGES, v, side="right") - 1
    b[v == EDGES[-1]] = 9
    b[(v < EDGES[0]) | (v > EDGES[-1])] = -1
    return b


def psi(target: np.ndarray, n_target: int, ref: np.ndarray, n_ref: int) -> float:
    """Stability index of two histograms; values outside the ranges still count in the totals."""
    t = (target + fixed.PSI_EPS) / (n_target + fixed.PSI_EPS * 10)
    r = (ref + fixed.PSI_EPS) / (n_ref + fixed.PSI_EPS * 10)
    return max(0.0, round(float(((t - r) * np.log(t / r)).sum()), 6))


class Drift:
    """CUSUM and rolling stability index against a baseline.

    With ``relearn`` the first scores become the baseline, an alarm drops it, and the scores after
    an alarm give the domain its own alert threshold. Without it the rows bring ``base_mean,
    base_std, base_hist, base_n``. ``seen`` numbers the rows of a key from 1.
    """

    out = "seq long, ts long, severity string, detector string, psi double, cusum double, n_samples long, threshold double"
    #: Rows before a block that its window reaches, and rows that a fresh start takes for its baseline.
    lead, fresh = fixed.DRIFT_WINDOW, fixed.DRIFT_MIN

    def __init__(self, score: str = "risk_score", relearn: bool = True):
        self.score, self.relearn = score, relearn

    def number(self, counts: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        """Counters that a batch job takes from running sums and a stream carries along."""
        n = counts.get("seen", 0)
        return {"seen": n + len(pdf)}, pdf.assign(seen=np.arange(n + 1, n + len(pdf) + 1))

    def init(self) -> dict:
        return {"base": None, "buf": [], "raw": [], "cusum": 0.0, "start": 0, "warm": None, "threshold": None}

    def run(self, s: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        x = pdf[self.score].to_numpy(float)
        b = bins(x).tolist()
        seen, ts, x = pdf["seen"].tolist(), pdf["ts"].tolist(), x.tolist()
        if not self.relearn and s["base"] is None:
            r = pdf.iloc[0]
            s = {**s, "base": [float(r.base_mean), float(r.base_std), [int(c) for c in r.base_hist], int(r.base_n)]}
        base, buf, raw, cusum, start, warm, thr = (s[k] for k in ("base", "buf", "raw", "cusum", "start", "warm", "threshold"))
        buf, raw, warm = list(buf), list(raw), None if warm is None else list(warm)
        hist = np.bincount([i for i in buf if i >= 0], minlength=10).astype(float)
        ref = None if base is None else np.array(base[2], float)
        out = []
        for i, v in enumerate(x):
            if base is None:
                raw.append(v)
                if len(raw) >= fixed.DRIFT_MIN:
                    a = np.array(raw)
                    ref = np.bincount([k for k in bins(a) if k >= 0], minlength=10).astype(float)
                    base = [float(a.mean()), float(max(a.std(), 1e-4)), ref.astype(int).tolist(), len(raw)]
                    buf, raw, cusum, start, hist = [], [], 0.0, seen[i], np.zeros(10)
                continue
            buf.append(b[i])
            if b[i] >= 0:
                hist[b[i]] += 1
            if len(buf) > fixed.DRIFT_WINDOW:
                gone = buf.pop(0)
                if gone >= 0:
                    hist[gone] -= 1
            n_seen, event, p, c = seen[i] - start, None, 0.0, cusum
            if n_seen >= fixed.DRIFT_MIN:
                mu, sig = base[0], base[1]
                c = cusum = max(0.0, cusum + (v - mu) - fixed.CUSUM_K * sig)
                p = psi(hist, len(buf), ref, base[3])
                if cusum > fixed.CUSUM_H * sig:
                    event, cusum = ("ALARM", "CUSUM"), 0.0
                elif p >= fixed.PSI_ALARM:
                    event = ("ALARM", "PSI")
                elif p >= fixed.PSI_WARN:
                    event = ("WARN", "PSI")
            alarm = event is not None and event[0] == "ALARM"
            if self.relearn:
                if alarm:
                    base, buf, raw, cusum, hist = None, [], [], 0.0, np.zeros(10)
                    warm = [v]
                elif warm is not None:
                    warm.append(v)
                    if len(warm) >= fixed.DRIFT_MIN:
                        thr, warm = float(np.percentile(warm, 75)), None
            if event:
                out.append((seen[i], ts[i], *event, p, c, n_seen, thr))
        state = {"base": base, "buf": buf, "raw": raw, "cusum": cusum, "start": start, "warm": warm, "threshold": thr}
        return state, pd.DataFrame(out, columns=["seq", "ts", "severity", "detector", "psi", "cusum", "n_samples", "threshold"])


    def counts_from(self, state: dict, last: int) -> int:
        """The time from which a state's life counts: that of its last row."""
        return last

    def since(self, s: dict) -> int | None:
        """The row at which the baseline was complete."""
        return None if s["base"] is None else s["start"]

    def crossing(self, run: dict, pdf: pd.DataFrame) -> dict:
        """What a block does to a run with full window that does not end in it: the window it leaves, and for the CUSUM its end
        when it comes in at 0 and its highest, lowest and last running sum."""
        old = bins(pdf.loc[pdf["_lead"], self.score]).tolist()[-fixed.DRIFT_WINDOW:]
        own = pdf[~pdf["_lead"]]
        state, out = self.run({**run, "buf": old, "cusum": 0.0}, own)
        sums = np.cumsum(own[self.score].to_numpy(float) - run["base"][0] - fixed.CUSUM_K * run["base"][1])
        return {"ends": bool((out["severity"] == "ALARM").any()), "zero": state["cusum"], "buf": state["buf"],
                "high": float(sums.max()), "low": float(sums.min()), "sum": float(sums[-1])}

    def crossed(self, run: dict, e: dict) -> dict | None:
        """The run's state behind the block, or nothing when it ends there."""
        c = run["cusum"]
        if e["ends"] or c + e["high"] > fixed.CUSUM_H * run["base"][1]:
            return None
        return {**run, "buf": e["buf"], "cusum": e["zero"] if c + e["low"] <= 0 or c == 0 else c + e["sum"]}


class Cusum(Drift):
    """Detection against a fixed baseline, as a rule whose only state is the CUSUM; the window comes from the rows before a block.

    A block's effect on the CUSUM is piecewise: entries up to a point are pulled to zero and end alike, those above others pass
    the limit at some row and start again from zero there, and those between are moved by the sum of the rows. Pieces are (upper end,
    moved or not, value). Values of pieces that were at zero once are those of a walk, bit for bit.
    """

    lead = fixed.DRIFT_WINDOW - 1

    def __init__(self, score: str = "risk_score"):
        super().__init__(score, relearn=False)

    def init(self) -> float:
        return 0.0

    def run(self, c: float, pdf: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        old = bins(pdf.loc[pdf["_lead"], self.score]).tolist()[-self.lead:]
        state, out = super().run({**super().init(), "buf": old, "cusum": c}, pdf[~pdf["_lead"]])
        return state["cusum"], out

    def effect(self, pdf: pd.DataFrame) -> bytes:
        own = pdf[~pdf["_lead"]]
        mu, sig = float(own["base_mean"].iloc[0]), float(own["base_std"].iloc[0])
        top, pull = fixed.CUSUM_H * sig, fixed.CUSUM_K * sig
        low: list[float] = []  # end and value of the piece that was pulled to zero
        a, b, moved = -1.0, top, 0.0  # entries in (a, b] are moved
        high: list[list[float]] = []  # upper end and value of the pieces that have passed the limit, from the highest
        for x in own.loc[own["seen"] >= fixed.DRIFT_MIN, self.score].to_numpy(float).tolist():
            step = lambda v: 0.0 if (v := max(0.0, v + (x - mu) - pull)) > top else v
            if low:
                low[1] = step(low[1])
            for piece in high:
                piece[1] = step(piece[1])
            if a < b:
                moved = moved + (x - mu) - pull
                if -moved > a:
                    a = min(-moved, b)
                    low = [a, 0.0]
                if top - moved < b:
                    if not high or high[-1][1] != 0.0:
                        high.append([b, 0.0])
                    b = max(top - moved, a)
            if len(high) > 1:
                high = [p for i, p in enumerate(high) if not i or p[1] != high[i - 1][1]]
        out = [(low[0], 0.0, low[1])] if low else []
        out += [(b, 1.0, moved)] if a < b else []
        return np.array(out + [(e, 0.0, v) for e, v in reversed(high)], "<f8").tobytes()

    @staticmethod
    def value(pieces: np.ndarray, c: float) -> float:
        i = min(int(np.searchsorted(pieces[:, 0], c)), len(pieces) - 1)
        return max(0.0, float(pieces[i, 2] + c)) if pieces[i, 1] else float(pieces[i, 2])

    def chain(self, effects: list[bytes]) -> bytes:
        now = np.frombuffer(effects[0], "<f8").reshape(-1, 3)
        for raw in effects[1:]:
            then, out, lower = np.frombuffer(raw, "<f8").reshape(-1, 3), [], -np.inf
            for end, moved, v in now.tolist():
                if moved:
                    for e, m, w in then.tolist():
                        if e - v > lower:
                            out.append((min(e - v, end), m, w + v if m else w))
                            lower = out[-1][0]
                        if e - v >= end:
                            break
                else:
                    out.append((end, 0.0, self.value(then, v)))
                lower = end
            now = np.array([p for i, p in enumerate(out) if i + 1 == len(out) or p[1] or out[i + 1][1:] != p[1:]])
        return now.astype("<f8").tobytes()

    def after(self, effect: bytes, c: float) -> float:
        return self.value(np.frombuffer(effect, "<f8").reshape(-1, 3), c)


class Cisc:
    """Adaptive tier thresholds from running counters.

    Rows bring the counters up to and including themselves (``n_obs, n_alerts, n_true, n_wrong,
    n_high, n_high_wrong``); only the two thresholds are state. Exploration is off, so replays agree.
    """

    out, lead = "seq long, high_threshold double, low_threshold double", 0

    def __init__(self, target_precision: float = 0.80, target_recall: float = 0.60, min_samples: int = 20):
        self.tp, self.tr, self.min = target_precision, target_recall, min_samples

    def number(self, counts: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        low, high, wrong = pdf["tier"] == "LOW", pdf["tier"] == "HIGH", pdf["was_wrong"].astype(bool)
        new = {"n_obs": pd.Series(1, index=pdf.index), "n_alerts": low, "n_true": low & wrong, "n_wrong": wrong,
               "n_high": high, "n_high_wrong": high & wrong}
        run = {k: v.astype("int64").cumsum() + counts.get(k, 0) for k, v in new.items()}
        return {k: int(v.iloc[-1]) for k, v in run.items()}, pdf.assign(**run)

    def counts_from(self, state: list, last: int) -> int:
        return last

    def init(self) -> list:
        return [fixed.CISC_HIGH, fixed.CISC_LOW]

    @staticmethod
    def clamp(v: float) -> float:
        return max(fixed.CISC_MIN, min(fixed.CISC_MAX, round(v, 3)))

    def states(self) -> list[list]:
        """All pairs of thresholds that moves can lead to from the first one."""
        if not hasattr(self, "_all"):
            seen, todo = {tuple(self.init())}, [tuple(self.init())]
            while todo:
                s = todo.pop()
                for low in (0, 1, -1):
                    for high in (0, 1, 2):
                        t = self.move(*s, low, high)
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
            self._all = [list(s) for s in sorted(seen)]
        return self._all

    def move(self, ht: float, lt: float, low: int, high: int) -> tuple[float, float]:
        """One outcome's effect: ``low`` -1 or 1 moves the low threshold, ``high`` 1 lowers the high one, 2 raises it if there is room."""
        if low:
            lt = self.clamp(lt + low * fixed.CISC_STEP)
        if high == 1:
            ht = self.clamp(ht - fixed.CISC_STEP)
        elif high == 2 and ht < lt - 0.10:
            ht = self.clamp(ht + fixed.CISC_STEP)
        return (ht, self.clamp(ht + 0.10)) if ht >= lt - 0.10 else (ht, lt)

    def moves(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row whether any rule applies, and its moves."""
        col = lambda c: pdf[c].to_numpy(float)
        p = (col("n_true") + 1) / (col("n_alerts") + 2) - self.tp
        r = (col("n_true") + 1) / (col("n_wrong") + 2) - self.tr
        h = np.divide(col("n_high_wrong"), col("n_high"), out=np.zeros(len(pdf)), where=col("n_high") > 0)
        low = np.where((p > 0.05) & (r < -0.05), -1, np.where(p < -0.05, 1, 0))
        return col("n_obs") >= self.min, low, np.where(h > 0.35, 1, np.where(h < 0.10, 2, 0))

    def effect(self, pdf: pd.DataFrame) -> bytes:
        return self.table(pdf).astype("<i4").tobytes()

    def chain(self, effects: list[bytes]) -> bytes:
        m = np.arange(len(self.states()), dtype="<i4")
        for raw in effects:
            m = np.frombuffer(raw, "<i4")[m]
        return m.astype("<i4").tobytes()

    def after(self, effect: bytes, s: list) -> list:
        states = self.states()
        return states[int(np.frombuffer(effect, "<i4")[states.index(s)])]

    def table(self, pdf: pd.DataFrame) -> np.ndarray:
        """The state that the rows leave for each state; equal moves in a row are applied until they change nothing."""
        states = [tuple(s) for s in self.states()]
        at = {s: i for i, s in enumerate(states)}
        steps = {}
        on, low, high = self.moves(pdf)
        kinds = (3 * (low[on] + 1) + high[on]).tolist()
        m, i = np.arange(len(states)), 0
        while i < len(kinds):
            k, j = kinds[i], i
            while j < len(kinds) and kinds[j] == k:
                j += 1
            if k not in steps:
                steps[k] = np.array([at[self.move(*s, k // 3 - 1, k % 3)] for s in states])
            for _ in range(j - i):
                new = steps[k][m]
                if (new == m).all():
                    break
                m = new
            i = j
        return m

    def run(self, s: list, pdf: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        ht, lt = s
        hs, ls = [], []
        for on, low, high in zip(*(x.tolist() for x in self.moves(pdf)), strict=True):
            if on:
                ht, lt = self.move(ht, lt, low, high)
            hs.append(ht)
            ls.append(lt)
        return [ht, lt], pd.DataFrame({"seq": pdf["n_obs"].to_numpy("int64"), "high_threshold": hs, "low_threshold": ls})


class Dedup:
    """An alert fires unless the same key fired less than ``window`` seconds before."""

    out = "ts long, chain_id long"

    def __init__(self, window: int = fixed.ALERT_DEDUP_SECONDS):
        self.window = window

    def number(self, counts: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        return counts, pdf

    def counts_from(self, state: dict, last: int) -> int:
        """That of the last alert that fired: once the window is over nothing is suppressed any more."""
        return last if state["last"] is None else state["last"]

    def init(self) -> dict:
        return {"last": None}

    def run(self, s: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        ts, last, hit = pdf["ts"].to_numpy("int64"), s["last"], []
        at = 0 if last is None else int(np.searchsorted(ts, last + self.window))
        while at < len(ts):
            hit.append(at)
            last = int(ts[at])
            at = int(np.searchsorted(ts, last + self.window))
        return {"last": last}, pdf.iloc[hit][["ts", "chain_id"]].reset_index(drop=True)
