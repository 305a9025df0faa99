"""Print job and stage durations from a Spark event log folder (zstd or plain)."""
import glob
import io
import json
import sys

import zstandard


def lines(path):
    if path.endswith(".zstd"):
        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        return io.StringIO(data.decode()).readlines()
    return open(path).readlines()


st, jobs = {}, {}
for f in sorted(glob.glob(sys.argv[1] + "/**/events_*", recursive=True)):
    for line in lines(f):
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageCompleted":
            i = e["Stage Info"]
            st[i["Stage ID"]] = (i["Stage Name"][:60], i["Number of Tasks"], i["Completion Time"] - i["Submission Time"])
        elif e["Event"] == "SparkListenerJobStart":
            jobs[e["Job ID"]] = e["Submission Time"]
        elif e["Event"] == "SparkListenerJobEnd":
            jobs[e["Job ID"]] = (jobs[e["Job ID"]], e["Completion Time"] - jobs[e["Job ID"]])
n = int(sys.argv[2]) if len(sys.argv) > 2 else 12
for k, v in sorted(jobs.items())[-n:]:
    print("job", k, v)
for k, v in sorted(st.items())[-n:]:
    print("stage", k, v)
