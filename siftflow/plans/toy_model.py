"""A hand-written ensemble of trees for each kind of record: no trained model is published, so these stand in."""

from __future__ import annotations


def _leaf(n: int, value: float) -> dict:
    return {"nodeid": n, "leaf": value}


def _split(n: int, feature: int, condition: float, yes: dict, no: dict, missing_yes: bool = True, depth: int = 0) -> dict:
    return {"nodeid": n, "depth": depth, "split": f"f{feature}", "split_condition": condition, "yes": yes["nodeid"], "no": no["nodeid"], "missing": (yes if missing_yes else no)["nodeid"], "children": [yes, no]}


FLOW_TREES = [
    _split(0, 0, 60.0, _split(1, 18, 20.0, _leaf(3, -0.9), _leaf(4, 0.35), depth=1), _split(2, 13, 40.0, _leaf(5, 0.8), _leaf(6, -0.2), missing_yes=False, depth=1)),
    _split(0, 15, 7.0, _leaf(1, -0.3), _split(2, 17, 530.0, _leaf(3, 0.6), _leaf(4, -0.1), depth=1), missing_yes=False),
    _split(0, 8, 26.0, _leaf(1, 0.25), _leaf(2, -0.4)),
]

#: Features 2 (rate), 29 (sum of lengths) and 4 (share of SYN).
PACKET_TREES = [
    _split(0, 2, 0.25, _leaf(1, -0.5), _split(2, 29, 40_000.0, _leaf(3, 0.7), _leaf(4, -0.1), depth=1)),
    _split(0, 4, 0.4, _leaf(1, 0.2), _leaf(2, 0.9), missing_yes=False),
]
