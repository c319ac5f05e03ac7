"""Sources and sinks: repositories, question files, versioned tables, run results and grading sheets."""
