"""Page assembly over micro-batches: whole, late, repeated and missing pages."""

import json
import tempfile

from pyspark.sql import functions as F

from folioscan.streaming import pages

FILE = "doc_id long, page_no int, page_count int, regions string, ts timestamp"


def run(spark, batches, late="10 minutes", wait=600):
    """Rows emitted by each micro-batch; one file a batch, one query with one checkpoint."""
    folder, out = tempfile.mkdtemp(dir="/tmp"), []
    source = spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).json(folder)
    query = None
    checkpoint = tempfile.mkdtemp(dir="/tmp")
    for k, rows in enumerate(batches):
        with open(f"{folder}/{k:03d}.json", "w") as file:
            file.writelines(json.dumps({"doc_id": d, "page_no": p, "page_count": n, "regions": f"{d}/{p}" + (x or ""), "ts": f"2024-06-01 {t}"}) + "\n" for d, p, n, t, x in rows)
        got = []
        query = pages.assemble_pages(source, late, wait).writeStream.foreachBatch(lambda df, _, got=got: got.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        out.append({(r.doc_id, tuple(r.pages), r.complete): tuple(r.regions) for r in got})
    return out


def test_documents_come_when_whole(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    one = [(1, 0, 2, "10:00:00", None), (2, 0, 3, "10:00:00", None), (3, 0, None, "10:01:00", None)]
    two = [(1, 1, 2, "10:02:00", None), (1, 1, 2, "10:02:10", " again"), (2, 1, 3, "10:03:00", None), (3, 1, 2, "10:03:00", None)]
    three = [(1, 0, 2, "10:05:00", " late copy"), (9, 0, 1, "11:00:00", None)]
    four = [(2, 2, 3, "10:04:00", " after the watermark"), (8, 0, 1, "11:30:00", None)]
    got = run(spark, [one, two, three, four])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == {}
    assert got[1] == {(1, (0, 1), True): ("1/0", "1/1"), (3, (0, 1), True): ("3/0", "3/1")}
    assert got[2].keys() >= {(9, (0,), True)} and not any(k[0] == 1 for k in got[2])  # a copy of a page doesn't emit again
    later = got[2] | got[3]
    assert later[2, (0, 1), False] == ("2/0", "2/1")  # overdue: as far as it came, the page behind the watermark left out
    assert (8, (0,), True) in got[3] and F is not None
