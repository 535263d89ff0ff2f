"""Jobs and views composed of operators."""
