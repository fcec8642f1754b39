"""Small fixtures and plain-Python statements of the rules, for comparison only."""

import math
import re

STOP = set("""the a an is are was were be been being have has had do does did will would could should may might shall can this that these
those it its they them their of in on at to for with by from up out as into through and or but not so if then than about which who what how
when where""".split())


def words(text):
    return {w for w in re.findall("[a-z]+", text.lower()) if len(w) > 1 and w not in STOP}


def step(thought="", kind="Search", arg="", obs=""):
    return (thought, kind, arg, obs)


CHAINS = {
    1: ("Who wrote Hamlet?", [step("I should search for Hamlet", "Search", "Hamlet author", "Hamlet is a tragedy written by William Shakespeare around 1600"),
                              step("The author is clear now", "Finish", "Shakespeare", "")], "William Shakespeare"),
    2: ("When was the tower built?", [step("search tower", "Search", "tower", "no results"), step("search again", "Search", "tower", "no results"),
                                      step("maybe once more", "Search", "Tower ", "no results"), step("give up", "Finish", "unknown", "")], "unknown"),
    3: ("", [step("", "Search", "x", ""), step("", "Search", "y", "")], ""),
    4: ("Only the question", [step("the of and", "Finish", "1889", "in 1889 it was built")], "1889"),
    5: ("No steps here", [], "Answer"),
    6: ("Où est la tour ?", [step("Je cherche la tour à Paris", "Search", "tour", "La tour Eiffel est à Paris")] * 8, "À Paris"),
}


def frames(spark, chains=CHAINS):
    steps = [(c, i, *s) for c, (_, ss, _) in chains.items() for i, s in enumerate(ss)]
    rows = [(c, q, a) for c, (q, _, a) in chains.items()]
    return (spark.createDataFrame(steps, "chain_id long, step_idx long, thought string, action_type string, action_arg string, observation string"),
            spark.createDataFrame(rows, "chain_id long, question string, final_answer string"))


def behaviour(question, steps, answer):
    """The documented weighted mean, written out for one chain."""
    n, pairs = len(steps), [(words(t), words(o)) for t, _, _, o in steps if t and o]
    part = lambda a, b: len(a & b) / max(len(a | b), 1)
    avg = lambda xs, d=0.5: sum(xs) / len(xs) if xs else d
    obs = " ".join(s[3] for s in steps)
    ver = [len(s[0].split()) for s in steps if s[0]]
    items = [(1 - len({s[1] for s in steps}) / max(n, 1), 1), (min(n / 10, 1), 1), (1 - avg([part(a, b) for a, b in pairs if a | b]), 1),
             (min(sum(ver) / (50 * max(len(ver), 1)), 1), 1),
             (1 - len(words(answer) & words(obs)) / max(len(words(answer)), 1) if answer and obs else 0.5, 1), (1 - part(words(question), words(answer)), 1.2)]
    if n >= 3:
        th = [words(s[0]) for s in steps]
        items += [(avg([len(a & b) / max(len(b), 1) for a, b in pairs]), 1.3),
                  (avg([part(x, y) for x, y in zip(th, th[1:]) if x | y]), 1.3)]
        if len(pairs) >= 3:
            rise = (1 - part(*pairs[-1])) - (1 - part(*pairs[0]))
            items.append((math.tanh(5 * rise / (n - 1)) * 0.5 + 0.5, 0.8))
    return sum(v * w for v, w in items) / sum(w for _, w in items)
