from codeskein.cli import main

main()
