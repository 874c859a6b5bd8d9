"""How far the different texts of a table are from sampled pivots, for the README.

``python -m tests.llm.pivot_shares check_s [pivots]`` prints the share of texts whose
nearest other pivot is at a Jaccard distance of 0.6 or more, and of 0.9 or more. Distances
are exact: an index from shingles to pivots gives all shared ones.
"""

import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds

from millrace.llm.common import slices
from millrace.llm.jaccard import shingle_sets


def shares(table: str, pivots: int = 1000) -> tuple[int, float, float]:
    texts = ds.dataset(f"/root/testdata/{table}/documents.parquet").to_table(columns=["text"]).combine_chunks()
    found = {own.tobytes(): own for batch in texts.to_batches() for part in slices(batch, 0) for own in shingle_sets(part.column(0)) if len(own)}
    sets = list(found.values())
    chosen = np.random.default_rng(0).choice(len(sets), min(pivots, len(sets)), replace=False)
    index = defaultdict(list)
    for p in chosen.tolist():
        for shingle in sets[p].tolist():
            index[shingle].append(p)
    nearest = np.zeros(len(sets))
    for k, own in enumerate(sets):
        shared = Counter(p for shingle in own.tolist() for p in index.get(shingle, ()) if p != k)
        nearest[k] = max((n / (len(own) + len(sets[p]) - n) for p, n in shared.items()), default=0.0)
    return len(sets), float((nearest <= 0.4).mean()), float((nearest <= 0.1).mean())


if __name__ == "__main__":
    count, far, farther = shares(sys.argv[1], *map(int, sys.argv[2:3]))
    print(f"{count} different texts: nearest pivot at 0.6 or more for {100 * far:.1f} %, at 0.9 or more for {100 * farther:.1f} %")
