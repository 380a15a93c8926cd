"""What a map keeps under a budget of tokens: facts are admitted in the order of their rank, each trial a whole rendered map.

The search is a loop over the facts of one snapshot, as every trial depends on the one before; its input is bounded by what a map can
show, and it runs within the task that puts the map together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

#: Whole maps that are rendered at most, those of them that the repair pass can count on, and the share of the budget from which it counts as used.
TRIALS, REPAIR, SATURATED = 128, 32, 0.99


@dataclass
class Search:
    """What a search found and how."""

    text: str
    kept: frozenset
    trials: int = 0
    truncated: bool = False
    stop: str = "exhausted"
    tried: int = field(default=0)


def tokens(text: str) -> int:
    return (len(text) + 3) // 4


def search(floor: str, facts: list, closure: Callable[[object], Iterable], render: Callable[[frozenset], str], budget: int, most: int = TRIALS, repair: int = REPAIR) -> Search:
    """facts in the order of their rank, closure(fact): the names that come with it, render(names): the whole map with them above the floor.

    Facts are admitted in runs that double while the map fits and halve when it doesn't; a single one that doesn't fit is passed over. A
    second pass tries those passed over again, as later facts can make earlier ones cheaper. A map that doesn't fit is never kept."""
    closures = [frozenset(closure(f)) for f in facts]
    best, kept, trials, truncated = floor, frozenset(), 0, False

    def fits(names: frozenset) -> str | None:
        nonlocal trials
        trials += 1
        text = render(names)
        return text if tokens(text) <= budget else None

    at, run = 0, 1
    while at < len(facts) and tokens(best) / budget < SATURATED:
        if trials >= max(1, most - repair):
            truncated = True
            break
        names = kept.union(*closures[at : at + run])
        text = fits(names)
        if text is not None:
            best, kept, at, run = text, names, at + run, min(run * 2, len(facts))
        elif run > 1:
            run //= 2
        else:
            at += 1
    for names in closures:
        if tokens(best) / budget >= SATURATED:
            break
        if trials >= most:
            truncated = True
            break
        if not names <= kept:
            text = fits(kept | names)
            if text is not None:
                best, kept = text, kept | names
    stop = "saturated" if tokens(best) / budget >= SATURATED else "trial-limit" if truncated else "exhausted" if facts else "no-candidates"
    return Search(best, kept, trials, truncated, stop, len(facts))


def smallest(candidates: list[str]) -> int:
    """The number of the smallest whole map, the first of equals."""
    return min(range(len(candidates)), key=lambda k: (tokens(candidates[k]), k))


def statistics(budget: int | None, full: str, selected: str, floor: str, detail: str, facts: dict, kept: set, found: Search | None = None, stop: str = "not-limited") -> dict:
    """The decision as plain values in a fixed order; facts: name -> (category, reason)."""
    limited = bool(budget and budget > 0)
    kept = kept & facts.keys()
    dropped = facts.keys() - kept
    counts = lambda names, k: dict(sorted(Counter(facts[n][k] for n in names if facts[n][k]).items()))
    return {
        "requested_budget": budget, "full_tokens": tokens(full), "selected_tokens": tokens(selected), "skeleton_tokens": tokens(floor), "effective_detail": detail, "utilization": tokens(selected) / budget if limited else None, "fits": not limited or tokens(selected) <= budget,
        "retained_categories": counts(kept, 0), "dropped_categories": counts(dropped, 0), "retained_bundles": sorted(kept), "dropped_bundles": sorted(dropped),
        "selection_trials": found.trials if found else 0, "selection_candidates": found.tried if found else 0, "search_truncated": bool(found and found.truncated), "stop_reason": found.stop if found else stop, "retained_reasons": counts(kept, 1), "dropped_reasons": counts(dropped, 1),
    }
