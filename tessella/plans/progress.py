"""How far a run is, read from another thread than the one that runs."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession


class Progress:
    """A callback for runs that report (step, share, message).

    Each step's jobs get a job group of their own. read() finds their tasks
    through Spark's status tracker and fills the way from the step's share
    to the next step's; shares never fall, but for 0 when the run has failed.
    """

    def __init__(self, spark: SparkSession, name: str = "run", shares: tuple[int, ...] = (0, 10, 35, 60, 80, 90, 95, 100)):
        self.context, self.name, self.shares = spark.sparkContext, name, shares
        self.key = uuid.uuid4().hex
        self.lock = threading.Lock()
        self.step, self.share, self.message, self.most = "starting", 0, "", 0.0

    def __call__(self, step: str, share: int, message: str) -> None:
        with self.lock:
            self.step, self.share, self.message = step, share, message
            self.most = float(share) if step == "error" else max(self.most, float(share))
        self.context.setJobGroup(self._group(step), f"{self.name}: {message or step}")

    def _group(self, step: str) -> str:
        return f"{self.key}:{step}"

    def read(self) -> dict:
        """step, progress (0 to 100), message, and the tasks that have ended of those known so far in this step."""
        with self.lock:
            step, share, message = self.step, self.share, self.message
        tracker, done, tasks = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self._group(step)):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                at = tracker.getStageInfo(stage)
                if at:
                    done, tasks = done + at.numCompletedTasks, tasks + at.numTasks
        after = min((s for s in self.shares if s > share), default=100)
        now = share if step in ("error", "done") or not tasks else share + (after - share) * 0.95 * done / tasks
        with self.lock:
            if step == self.step and step != "error":
                self.most = max(self.most, now)
            return {"step": self.step, "progress": 0.0 if self.step == "error" else self.most, "message": self.message if step != self.step else message, "tasks_done": done, "tasks": tasks}
