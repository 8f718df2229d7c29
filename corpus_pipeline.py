"""The corpus pipeline at the place where the driver looks for it; its stages are in quarrylens.llm.pipeline."""

from quarrylens.llm.pipeline import ORACLE_SQL, STAGES, leak_stage, mixing_stage, near_copy_stage, quality_stage, run, token_stage

__all__ = ["ORACLE_SQL", "STAGES", "leak_stage", "mixing_stage", "near_copy_stage", "quality_stage", "run", "token_stage"]
