"""gradeweave: analytics over course offers and registrations, as Spark jobs."""
