"""Visiting the places of a nested document by dotted paths, where a list stands for each of its items."""

from __future__ import annotations

from collections.abc import Callable, Iterator


def places(document: object, path: str) -> Iterator[tuple[object, str, object]]:
    """(holder, key, value) of every place that ``path`` reaches. Missing places are passed over."""
    *ways, last = path.split(".")
    holders = [document]
    for way in ways:
        found = []
        for holder in holders:
            value = holder.get(way) if isinstance(holder, dict) else None
            found += value if isinstance(value, list) else [] if value is None else [value]
        holders = found
    for holder in holders:
        if isinstance(holder, dict) and last in holder:
            yield holder, last, holder[last]


def values(document: object, path: str, each: bool = True) -> list[object]:
    """The values at ``path``; items of lists one by one unless ``each`` is false."""
    found = []
    for _, _, value in places(document, path):
        found += value if each and isinstance(value, list) else [value]
    return found


def change(document: object, path: str, by: Callable[[object], object], each: bool = True) -> None:
    """Put ``by(value)`` in the place of every value at ``path``; None takes the place away. Lists item by item unless ``each`` is false."""
    for holder, key, value in list(places(document, path)):
        if each and isinstance(value, list):
            holder[key] = [x for x in map(by, value) if x is not None]
        elif (new := by(value)) is None:
            del holder[key]
        else:
            holder[key] = new


def differences(before: object, after: object, where: str = "") -> list[tuple[str, object, object]]:
    """(place, before, after) of every value that is not the same; None for absent ones."""
    if isinstance(before, dict) and isinstance(after, dict):
        keys = [*before, *(k for k in after if k not in before)]
        return [d for k in keys for d in differences(before.get(k), after.get(k), f"{where}.{k}".lstrip("."))]
    if isinstance(before, list) and isinstance(after, list):
        pairs = [(before[i] if i < len(before) else None, after[i] if i < len(after) else None) for i in range(max(len(before), len(after)))]
        return [d for i, (b, a) in enumerate(pairs) for d in differences(b, a, f"{where}[{i}]")]
    return [] if before == after and type(before) is type(after) else [(where, before, after)]
