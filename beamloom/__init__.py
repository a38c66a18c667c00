"""Detector list-mode analytics as Spark DataFrame jobs."""

from beamloom.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
