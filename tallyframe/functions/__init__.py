"""Column expressions: no function here touches data or starts a job."""
