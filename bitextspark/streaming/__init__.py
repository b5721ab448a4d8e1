"""Running averages, task bandit, windowed influence and incremental intake."""
