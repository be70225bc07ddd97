"""SQL checks by query name."""

from oracle import campaign, core, stats, streaming

CHECKS: dict[str, str] = {**core.CHECKS, **campaign.CHECKS, **stats.CHECKS, **streaming.CHECKS}
