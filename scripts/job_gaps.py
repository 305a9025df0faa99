"""Jobs of the last run in an event log: duration and driver-side gap before each one."""
import glob
import json
import sys

import numpy as np
import zstandard

jobs, names = {}, {}
for f in sorted(glob.glob(sys.argv[1] + "/**/events_*", recursive=True)):
    raw = open(f, "rb").read()
    data = zstandard.ZstdDecompressor().stream_reader(__import__("io").BytesIO(raw)).read().decode() if f.endswith(".zstd") else raw.decode()
    for line in data.splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None]
            names[e["Job ID"]] = (e.get("Properties", {}) or {}).get("callSite.short", "")
        elif e["Event"] == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
ks = sorted(jobs)
starts = [jobs[k][0] for k in ks]
cut = int(np.argmax(np.diff(starts))) + 1 if len(ks) > 1 else 0
sec = ks[cut:] if len(sys.argv) < 3 else ks
print("jobs", len(sec), "busy ms", sum(jobs[k][1] - jobs[k][0] for k in sec), "wall ms", jobs[sec[-1]][1] - jobs[sec[0]][0])
prev = None
for k in sec:
    s, e = jobs[k]
    print(k, "dur", e - s, "gap", (s - prev) if prev else 0, names[k][:50])
    prev = e
