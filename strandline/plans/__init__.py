"""Multi-step dataflows: evaluation, dataset building, variation, reports, whole runs."""
