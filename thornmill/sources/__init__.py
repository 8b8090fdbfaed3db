"""Table functions and the forms in which results are written."""
