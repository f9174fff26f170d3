"""Jobs: fits, baselines, evaluation, sweeps and reports."""
