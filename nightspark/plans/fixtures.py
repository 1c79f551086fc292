"""Small model tables for the registered queries, the same on both engines.

They are built from a rule, not fitted: labels from a fit are not portable.
"""

from __future__ import annotations

from nightspark import config as C

MORPH_CENTROIDS = tuple(
    tuple(((k * 5 + j * 3) % 7 - 3) / 4.0 for j in range(len(C.EVENT_FEATURES))) for k in range(4)
)
MORPH_LABELS = C.GREEK[:4]
CURVE_DEPTHS = (3.0, 6.0, 9.0, 12.0, 16.0)
CURVE_CENTROIDS = tuple(
    tuple(round(-d * (1 - abs(2 * i / 29.0 - 1)), 6) for i in range(C.CURVE_POINTS)) for d in CURVE_DEPTHS
)
# the twin ranks by round(d, 9) * 100 + k, so distances within 0.01 of each other go to the lower index
CURVE_PLACES_PER_UNIT = 100.0
STATE_CENTROIDS = {
    s: tuple(
        tuple(((k * 7 + j * 3) % 11 - 5) / 4.0 for j in range(len(C.WINDOW_FEATURES)))
        for k in range(C.STATE_K[s])
    )
    for s in "sml"
}
STATE_LABELS = {s: tuple(f"{C.STATE_PREFIX[s]}{k}" for k in range(C.STATE_K[s])) for s in "sml"}
