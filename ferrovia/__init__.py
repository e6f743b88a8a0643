"""Rail network and timetable jobs on Spark."""
