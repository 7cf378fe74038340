"""Batch jobs over whole tables: the anomaly refresh (M11, K4) and the matrix build."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logweave import schemas
from logweave.operators.features import event_matrix, label_matrix
from logweave.operators.kmeans import kmeans_detector
from logweave.operators.spikes import error_spikes, spike_anomalies
from logweave.sources.sinks import refresh_anomalies


def detect_batch(matrix: DataFrame, logs: DataFrame, path: str, detected_at: str, k: int = 8,
                 contamination: float = schemas.CONTAMINATION_DEFAULT, spike_seconds: int = 60) -> None:
    """K-Means anomalies of the matrix and error spikes of the logs replace
    the anomaly table at ``path``."""
    refresh_anomalies([kmeans_detector(matrix, detected_at, k, contamination),
                       spike_anomalies(error_spikes(logs, seconds=spike_seconds), detected_at)], path)


def build_matrix(structured: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A20 + J2: event counts per block of a structured log, labelled if labels are given."""
    matrix = event_matrix(structured)
    return matrix if labels is None else label_matrix(matrix, labels)
