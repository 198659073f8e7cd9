"""Tables, and the worlds that stand in for sensors and maps where only business tables are at hand."""
