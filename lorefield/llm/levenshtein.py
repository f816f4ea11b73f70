"""Levenshtein automata intersected with a lexicon trie, as one table that reads all words of a text at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NONE, FUZZY, EXACT = 0, 1, 2


@dataclass(frozen=True)
class Term:
    """A lexicon entry; a stem matches every word that begins with it. `edits` is the distance still accepted."""

    text: str
    stem: bool
    edits: int


@dataclass(frozen=True)
class Automaton:
    """Next state by [state, letter class], what a word that ends in the state is, and the term it is nearest to. State 0 is dead."""

    letters: dict[int, int]
    table: np.ndarray
    kind: np.ndarray
    term: np.ndarray


def build(terms: list[Term]) -> Automaton:
    """Determinise the product of the trie and the edit automata. A state is a set of (trie node, edits left)."""
    letters = {ord(c): i + 1 for i, c in enumerate(sorted({c for t in terms for c in t.text}))}
    children: list[dict[int, int]] = []
    ends: list[int] = []

    def node() -> int:
        children.append({})
        ends.append(-1)
        return len(children) - 1

    roots: dict[int, int] = {}
    for number, term in enumerate(terms):
        # Stems and whole words, and terms with different distances, live in tries of their own.
        at = roots.setdefault(2 * term.edits + term.stem, -1)
        if at < 0:
            at = roots[2 * term.edits + term.stem] = node()
        for c in term.text:
            following = children[at].get(letters[ord(c)])
            if following is None:
                following = children[at][letters[ord(c)]] = node()
            at = following
        ends[at] = number

    def closed(items: dict[int, int]) -> frozenset[tuple[int, int]]:
        """Add what skipping letters of a term reaches; keep the most edits left for each node."""
        todo = list(items.items())
        while todo:
            at, left = todo.pop()
            if left and not (ends[at] >= 0 and terms[ends[at]].stem):
                for child in children[at].values():
                    if items.get(child, -1) < left - 1:
                        items[child] = left - 1
                        todo.append((child, left - 1))
        return frozenset(items.items())

    def step(state: frozenset[tuple[int, int]], letter: int) -> frozenset[tuple[int, int]]:
        items: dict[int, int] = {}

        def reach(at: int, left: int) -> None:
            if items.get(at, -1) < left:
                items[at] = left

        for at, left in state:
            if ends[at] >= 0 and terms[ends[at]].stem:
                reach(at, left)
                continue
            child = children[at].get(letter)
            if child is not None:
                reach(child, left)
            if left:
                reach(at, left - 1)
                for other in children[at].values():
                    reach(other, left - 1)
        return closed(items)

    if not terms:
        return Automaton(letters, np.zeros((2, 1), np.int32), np.zeros(2, np.int8), np.full(2, -1))
    start = closed({root: key // 2 for key, root in roots.items()})
    numbers = {frozenset(): 0, start: 1}
    table: list[list[int]] = [[0] * (len(letters) + 1)]
    waiting = [start]
    for state in waiting:
        row = []
        for letter in range(len(letters) + 1):
            following = step(state, letter)
            if following not in numbers:
                numbers[following] = len(numbers)
                waiting.append(following)
            row.append(numbers[following])
        table.append(row)
    kind, nearest = np.zeros(len(numbers), np.int8), np.full(len(numbers), -1)
    for state, number in numbers.items():
        done = [(left - terms[ends[at]].edits, -ends[at]) for at, left in state if ends[at] >= 0]
        if done:
            best = max(done)
            kind[number] = EXACT if best[0] == 0 else FUZZY
            nearest[number] = -best[1]
    return Automaton(letters, np.array(table, np.int32), kind, nearest)


def read(automaton: Automaton, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """State in which each word ends; letters step in together and words drop out when their state is dead."""
    state = np.ones(len(start), np.int32)
    live, at = np.arange(len(start)), 0
    while len(live):
        state[live] = automaton.table[state[live], classes[start[live] + at]]
        at += 1
        live = live[(state[live] > 0) & (end[live] - start[live] > at)]
    return state
