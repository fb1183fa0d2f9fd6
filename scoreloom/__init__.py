"""Spark jobs for the data side of reward-based post-training."""

from scoreloom.config import DEFAULT, RewardConfig

__all__ = ["DEFAULT", "RewardConfig"]
