"""End-to-end orchestration: assembly, fitting and evaluation."""
