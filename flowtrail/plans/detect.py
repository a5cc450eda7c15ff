"""The detection plan: transfers to ranked queue, with staged tables in between."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from flowtrail.operators import cycles as cyc
from flowtrail.operators import detectors as det
from flowtrail.operators import graph, queue
from flowtrail.operators.filters import search_slice
from flowtrail.params import DetectionParams
from flowtrail.session import stage


@dataclass
class Detection:
    """Tables of one detection run; each is written once, on first use."""

    transfers: DataFrame
    params: DetectionParams = DetectionParams()

    @cached_property
    def search(self) -> DataFrame:
        return search_slice(self.transfers, self.params.rails)

    @cached_property
    def pairs(self) -> DataFrame:
        return stage(graph.pair_table(self.search), "pairs")

    @cached_property
    def accounts(self) -> DataFrame:
        return stage(graph.account_table(self.pairs), "accounts")

    @cached_property
    def edges(self) -> DataFrame:
        return stage(graph.enriched_edges(self.pairs, self.accounts), "edges")

    def detect(self, cycle_length: int | None = None) -> DataFrame:
        """Union of the five detectors, unstaged."""
        p = self.params
        return queue.candidate_union(
            det.fan_out(self.edges, p),
            det.fan_in(self.edges, p),
            det.pass_through(self.search, self.accounts, p),
            det.velocity_burst(self.accounts, p),
            cyc.cycles(self.edges, cycle_length or p.cycle_length),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return stage(self.detect(), "candidates", partition_by=("kind",))

    @cached_property
    def ranked(self) -> DataFrame:
        """The queue without evidence and signals; written by its ranking."""
        return queue.ranked(self.candidates, self.params)

    @cached_property
    def rings(self) -> DataFrame:
        return stage(queue.combine(self.candidates, self.params, self.ranked), "rings")
