"""Point-in-time panel analytics as DataFrame-to-DataFrame operators on Spark."""
