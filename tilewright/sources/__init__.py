"""Where slides, maps and documents come from and go to."""
