"""The streamed confusion matrix: its state is read by many tasks."""

from seamline.streaming.confusion import count_predictions, counted


def test_the_matrix_state_is_not_read_in_one_task(spark, tmp_path):
    last = lambda: next(k for k in range(10**9) if tracker.getJobInfo(k) is None and tracker.getJobInfo(k + 1) is None)
    tracker = spark.sparkContext.statusTracker()
    rows = [(k % 3, k % 2) for k in range(60)]
    spark.createDataFrame(rows, "label int, pred int").write.parquet(f"{tmp_path}/in")
    job = spark._jsc.sc().dagScheduler().nextJobId() if hasattr(spark._jsc.sc().dagScheduler(), "nextJobId") else last()
    job = job if isinstance(job, int) else job.get()
    count_predictions(spark.readStream.schema("label int, pred int").parquet(f"{tmp_path}/in"), f"{tmp_path}/matrix", f"{tmp_path}/state")
    assert sorted(map(tuple, counted(spark, f"{tmp_path}/matrix").collect())) == [(a, b, 10) for a in range(3) for b in range(2)]
    stages = [info.stageIds for k in range(job, job + 20) if (info := tracker.getJobInfo(k))]
    assert any(len(s) >= 3 for s in stages)
