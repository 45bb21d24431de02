from .jobs import run_issues, run_memory, workspace

__all__ = ["run_issues", "run_memory", "workspace"]
