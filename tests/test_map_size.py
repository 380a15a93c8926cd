import random

from symscape.plans import maps


def test_trials_go_through_the_files_they_show():
    rng = random.Random(9)
    files = [(f"f{k:03}", [(j, "method", rng.random() < 0.01, f"h{k}_{j}", " > c") for j in range(3)]) for k in range(200)]
    shown = maps._shown(files)
    for size in (0, 1, 5, 90):
        keep = {(f"f{rng.randrange(200):03}", rng.randrange(3), rng.choice(["method", "chain"])) for _ in range(size)}
        assert maps._put_together(shown(keep), keep) == maps._put_together(files, keep)
        assert len(shown(keep)) <= size + sum(any(r[2] for r in own) for _, own in files)
