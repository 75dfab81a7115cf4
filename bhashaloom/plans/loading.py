"""A loader of batches that keeps its place, over tables of sequences.

What each batch holds is worked out by operators.loader once for a split and written to the shared checkpoint folder; the loader itself is
a few counters, so that its state can be stored as a dict and taken up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bhashaloom.operators.loader import mixed_batches, single_batches
from bhashaloom.plans.skew import checkpointed

MODES = ("train", "test")


class Loader:
    """Batches of a table (split, lang, key and others), mixed over languages or of one, in train or test mode.

    A split's batches are made when they are first asked for and held for the next time. Mixed batches have one counter, which
    modes share; a language has a counter in each mode, and begins again when its batches run out. A switch of the mode moves none.
    """

    def __init__(self, sequences: DataFrame, batch: int, split: str = "split_name", lang: str = "lang", key: str = "seq_id", mode: str = "train", seed: int = 42):
        self.sequences, self.batch, self.split, self.lang, self.key, self.seed = sequences.where(F.col(lang).isNotNull()), batch, split, lang, key, seed
        self.counts: dict[str, dict[str, int]] = {m: {} for m in MODES}
        for r in self.sequences.groupBy(split, lang).agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each language and split
            if r[split] in MODES:
                self.counts[r[split]][r[lang]] = r["n"]
        self.position, self.places, self.consumed = 0, {m: dict.fromkeys(self.counts[m], 0) for m in MODES}, dict.fromkeys(MODES, 0)
        self._held: dict[tuple[str, str], DataFrame] = {}
        self.switch_mode(mode)

    def switch_mode(self, mode: str) -> None:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        self.mode = mode

    def languages(self) -> list[str]:
        """Languages of the mode, by name."""
        return sorted(self.counts[self.mode])

    def __len__(self) -> int:
        """Mixed batches of the mode."""
        return sum(self.counts[self.mode].values()) // self.batch

    def _batches(self, kind: str) -> DataFrame:
        """(batch, slot, lang, key) of the mode, written once."""
        if (self.mode, kind) not in self._held:
            keys = self.sequences.where(F.col(self.split) == self.mode).select(self.lang, self.key)
            made = mixed_batches(keys, self.lang, self.key, self.batch, self.seed) if kind == "mixed" else single_batches(keys, [self.lang], self.key, self.batch)
            self._held[self.mode, kind] = checkpointed(made)
        return self._held[self.mode, kind]

    def _records(self, keys: DataFrame) -> DataFrame:
        """The sequences of a batch, which is broadcast, as it has ``batch`` rows."""
        own = self.sequences.where(F.col(self.split) == self.mode)
        return own.join(F.broadcast(keys.select("slot", self.lang, self.key)), [self.lang, self.key]).select("slot", *self.sequences.columns)

    def next_batch(self) -> DataFrame:
        """The next mixed batch of the mode: (slot, and all columns). StopIteration at the end of the mode's batches."""
        if self.position >= len(self):
            raise StopIteration
        out = self._records(self._batches("mixed").where(F.col("batch") == self.position))
        self.position, self.consumed[self.mode] = self.position + 1, self.consumed[self.mode] + 1
        return out

    def restart(self) -> None:
        """Goes back to the first mixed batch, and to the first batch of each language of the mode."""
        self.position, self.places[self.mode] = 0, dict.fromkeys(self.counts[self.mode], 0)

    def language_batch(self, language: str) -> DataFrame:
        """The next batch of a language of the mode; the last of a round may be short. ValueError for an unknown language."""
        if language not in self.counts[self.mode]:
            raise ValueError(f"no language {language} in mode {self.mode}")
        place = self.places[self.mode][language]
        self.places[self.mode][language] = (place + 1) % -(-self.counts[self.mode][language] // self.batch)
        self.consumed[self.mode] += 1
        return self._records(self._batches("single").where((F.col(self.lang) == language) & (F.col("batch") == place)))

    def batch_of(self, mode: str, language: str | None = None) -> DataFrame:
        """A batch of a mode, whichever is on, which stays on even if there is none: mixed, or of a language."""
        before = self.mode
        self.switch_mode(mode)
        try:
            return self.next_batch() if language is None else self.language_batch(language)
        finally:
            self.switch_mode(before)

    def state(self) -> dict:
        """Counters by which a new loader of the same table goes on from here."""
        return {"mode": self.mode, "position": self.position, "places": {m: dict(p) for m, p in self.places.items()}}

    def resume(self, state: dict) -> None:
        """Takes up a state."""
        self.switch_mode(state["mode"])
        self.position, self.places = state["position"], {m: dict(p) for m, p in state["places"].items()}

    def statistics(self) -> DataFrame:
        """(mode, lang, n_sequences, weight, consumed): what each split holds of each language, its share, and batches given in the mode."""
        rows = [(m, g, n, round(n / sum(c.values()), 9), self.consumed[m]) for m, c in self.counts.items() for g, n in c.items()]
        return self.sequences.sparkSession.createDataFrame(rows, f"mode string, {self.lang} string, n_sequences bigint, weight double, consumed bigint")
