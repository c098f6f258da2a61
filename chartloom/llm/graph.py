"""What the training-data operators share with the core, and their own helpers: bounded Arrow batches, and bit maps that keep rows from a shuffle."""

from __future__ import annotations

from chartloom.operators.graphs import connected_components
from chartloom.operators.joins import likely, with_bit
from chartloom.sources.scratch import BATCH_BYTES, Scratch, bound_batches, cut, erase, shared_dir, shuffles_freed

__all__ = ["BATCH_BYTES", "Scratch", "bound_batches", "connected_components", "cut", "erase", "likely", "shared_dir", "shuffles_freed", "with_bit"]
